"""Collects queries and their SQL checks under the name of the function."""

from strandline.fixtures import Fixtures


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def query(self, sql: str | None = None):
        def register(fn):
            self.queries[fn.__name__] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
            if sql is not None:
                self.sql[fn.__name__] = sql
            return fn
        return register
