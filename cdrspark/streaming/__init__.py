"""The engine is batch only: every input is a finite table, so nothing is registered here."""
