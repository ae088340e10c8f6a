"""The engine as one object: a store of logs with search, counts, catalogue and upkeep."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

from .config import EngineConfig
from .operators import index, metrics, search
from .operators.store import Meta, Store
from .plans.predicate import labels_match
from .plans.temql import Matcher, Query, parse
from .sources import push, remote


class Engine:
    """logs: a DataFrame of the log schema; store: a folder that index() or a stream fills."""

    def __init__(self, spark: SparkSession, store: str | None = None, logs: DataFrame | None = None, config: EngineConfig = EngineConfig()):
        if (store is None) == (logs is None):
            raise ValueError("either a store or logs")
        self.spark, self._logs, self.config = spark, logs, config
        self.store = Store(spark, store, config) if store is not None else None

    def logs(self, mint: int | None = None, maxt: int | None = None) -> DataFrame:
        return search.in_range(self._logs, mint, maxt) if self.store is None else self.store.logs(mint, maxt)

    def index(self, requests: DataFrame) -> DataFrame:
        """Append push requests (column streams, or entries as push.decode_protobuf gives them) to the store as one block;
        the dead letters are returned."""
        logs, dead = push.to_logs(push.flatten(requests) if "streams" in requests.columns else requests)
        self.store.append(logs)
        return dead

    def search(self, temql: str, mint: int | None = None, maxt: int | None = None, count: int | None = None, **options) -> DataFrame:
        """Over a store the index comes first; series without a hit (include_empty) come from the series tables."""
        if self.store is None:
            return search.search(self._logs, temql, mint, maxt, count, **options)
        query = parse(temql)
        logs = self.store.scan(query, mint, maxt, options.get("tokenizer", search.DEFAULT), options.get("semantics", "record"))
        known = self.store.series(query).select("series_key") if options.get("include_empty") and query is not None else None
        return search.search(logs, temql, mint, maxt, count, known=known, **options)

    def search_json(self, temql: str, mint: int, maxt: int, count: int) -> list[str]:
        """One JSON text a series, series in order: at most count lines of each, so the answer is bounded by the series."""
        found = search.as_json(self.search(temql, mint, maxt, count, include_empty=True))
        return [r.json for r in found.orderBy("series_key").collect()]

    def read(self, matchers: list[Matcher], start: int, end: int, step: int, drop_last: bool = False) -> DataFrame:
        logs = self.logs(start, end) if self.store is None else self.store.scan(Query(None, tuple(matchers)), start, end)
        return metrics.step_count(logs.filter(labels_match(tuple(matchers), logs.columns)), start, end, step, drop_last)

    def remote_read(self, request: bytes, drop_last: bool = False) -> bytes:
        """A remote-read request to its response; a query that fails gives an empty result."""
        results = []
        for q in remote.decode_read(request):
            series = []
            if q.step > 0:
                counts = self.read(list(q.matchers), q.start, q.end, q.step, drop_last)
                labels = {r.series_key: r.labels for r in self.series(list(q.matchers)).select("series_key", "labels").collect()}
                rows = counts.orderBy("series_key", "bucket_end_ms").collect()
                series = [(labels.get(k, {}), [(r.bucket_end_ms, r.value) for r in group]) for k, group in groupby(rows, lambda r: r.series_key)]
            results.append(series)
        return remote.encode_response(results)

    def series(self, matchers: list[Matcher] | None = None, mint: int | None = None, maxt: int | None = None) -> DataFrame:
        """(series_key, labels, n_logs, min_ts, max_ts) of the series that the matchers select."""
        query = Query(None, tuple(matchers or ()))
        if self.store is not None:
            return self.store.series(query, mint, maxt)
        logs = self.logs(mint, maxt)
        return index.series_with_labels(logs.filter(labels_match(query.matchers, logs.columns)))

    def label_names(self) -> DataFrame:
        return index.label_names(self.series())

    def label_values(self) -> DataFrame:
        return index.label_values(self.series())

    def compact(self) -> list[Meta]:
        """Merge blocks until the planner names none any more, and delete what was merged."""
        out = []
        while (made := self.store.compact()) is not None:
            out.append(made)
        self.store.vacuum()
        return out

    def retain(self) -> list[str]:
        return self.store.retain()

    def delete_series(self, temql: str) -> list[Meta]:
        """Delete all lines of the series that the matchers of the query select."""
        query = parse(temql)
        if query is None or query.expr is not None:
            raise ValueError("label matchers alone say which series to delete")
        made = self.store.delete_series(query)
        self.store.vacuum()
        return made
