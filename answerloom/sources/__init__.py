"""Readers and writers: corpora, prompt files, generation records, reports, versions, run ledger."""
