"""Readers and writers of catalogue rows, dictionaries, snapshots and exports."""
