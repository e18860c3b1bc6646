"""End-to-end jobs: raw tables in, dictionaries of result tables out."""
