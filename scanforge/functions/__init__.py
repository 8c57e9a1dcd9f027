"""Part of the scanforge library; see README."""
