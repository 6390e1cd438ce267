"""Readers and writers of the registry tables, manifests and array images."""
