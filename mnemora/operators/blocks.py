"""Helpers of the task kernels: filters of searches and the best rows of each query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in schema])


def hits_schema(queries: DataFrame, rows: DataFrame, score: str) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("memory_id", rows.schema["memory_id"].dataType),
        T.StructField(score, T.DoubleType()),
    ])


def one(values) -> pa.Array:
    """A list column of one row that holds ``values``."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def plain(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


QUERY_FILTERS = ("access_keys", "project_path", "scope", "global_scope")
ROW_FILTERS = ("access_key", "project_path", "scope")


class Access:
    """Which rows the queries of a table may see, by those of ``QUERY_FILTERS`` that they have."""

    def __init__(self, queries: pa.Table):
        names = [c for c in QUERY_FILTERS if c in queries.column_names]
        self.queries = queries.select(names).to_pylist() if names else None
        self.known: dict[tuple, np.ndarray] = {}

    def _seen(self, key: str | None, path: str | None, scope: str | None) -> np.ndarray:
        """A query opens rows whose access key it holds, that have its scope where it names one, lie in or out of the global
        scope as it asks, and whose project path applies; private rows have no path rule."""
        if (key, path, scope) not in self.known:
            def sees(query) -> bool:
                if key is not None and key not in (query.get("access_keys") or ()):
                    return False
                if query.get("scope") is not None and query["scope"] != scope:
                    return False
                where = query.get("global_scope")
                if where == "only" and path is not None or where == "exclude" and not path:
                    return False
                own = query.get("project_path")
                if own is None or not path or "private:" in (key or ""):
                    return True
                return path == own or path.startswith(own + "/") or own.startswith(path + "/")

            self.known[key, path, scope] = np.array([sees(q) for q in self.queries], bool)
        return self.known[key, path, scope]

    def matrix(self, rows: dict[str, pa.Array]) -> np.ndarray | None:
        """Queries x rows, by the columns of ``ROW_FILTERS`` that ``rows`` has; None where nothing is filtered. Worked out once
        for each kind of row."""
        if self.queries is None or not any(c in rows for c in ROW_FILTERS):
            return None
        n = len(next(iter(rows.values())))
        codes, words = np.zeros(n, np.int64), []
        for name in ROW_FILTERS:
            column = rows[name].dictionary_encode() if name in rows else None
            words.append([None] if column is None else [*column.dictionary.to_pylist(), None])
            places = 0 if column is None else np.asarray(column.indices.fill_null(len(words[-1]) - 1))
            codes = codes * len(words[-1]) + places
        kinds, kind = np.unique(codes, return_inverse=True)
        many = [len(w) for w in words]
        seen = [self._seen(words[0][k // (many[1] * many[2])], words[1][k // many[2] % many[1]], words[2][k % many[2]])
                for k in kinds.tolist()]
        return np.stack(seen, axis=1)[:, kind] if seen else np.zeros((len(self.queries), 0), bool)


class TopRows:
    """The ``k`` best (score, id) per query among the rows offered so far; ties go to the lower id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0)] * n_queries
        self.ids: list = [None] * n_queries

    def offer(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.ids[n] is not None:
            scores, ids = np.concatenate([self.scores[n], scores]), np.concatenate([self.ids[n], ids])
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = scores >= edge
            scores, ids = scores[near], ids[near]
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores[n], self.ids[n] = scores[order], ids[order]

    def batch(self, names, schema: pa.Schema) -> pa.RecordBatch:
        if isinstance(names, pa.ChunkedArray):
            names = names.combine_chunks()
        take = np.repeat(np.arange(len(self.scores)), [len(s) for s in self.scores])
        ids = [i for part in self.ids if part is not None for i in part.tolist()]
        scores = np.concatenate(self.scores) if self.scores else np.empty(0)
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(take)).cast(schema.field(0).type), pa.array(ids, schema.field(1).type),
             pa.array(scores, pa.float64())], schema=schema)
