"""Part of rowsmith."""
