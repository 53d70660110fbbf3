"""A database for tests of loads: SQLite through its Python driver."""

import sqlite3


def connect(path: str):
    link = sqlite3.connect(path, timeout=60, isolation_level=None)
    link.execute("BEGIN IMMEDIATE")
    return link
