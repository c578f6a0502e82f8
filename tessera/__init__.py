"""Tessera: masking, pseudonymisation and analytics operators as Spark plans."""
