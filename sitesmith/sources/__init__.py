"""Readers and writers of scan, geometry and artefact formats."""
