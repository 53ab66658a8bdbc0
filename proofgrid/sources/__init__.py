"""Readers and writers of manifests, results, protocols and traces."""
