"""A script as a module, for a test of chains."""


def transform_records(rows):
    return [{"id": r["id"] + 1} for r in rows]
