"""A tenant's store: ingest, hot window, tiers, label index, and the four query surfaces over them."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .limits import Admission, within_time
from .model import INGEST_NS, empty, stamp
from .operators import lifecycle
from .operators.lifecycle import Materialization, Merge
from .operators.metrics import STEPS, pick_step, range_query
from .operators.union import union_by_name
from .plans import logql, promql, sqlapi
from .sources.catalog import Segment, bytes_on_disk, check_artifact, check_tenant, confined, hot_only, prune, read_logs, read_metrics, recent_floor, stat, tenant_views
from .sources.files import Files, is_local, join

#: Log columns whose values the label index holds.
INDEXED = ("format", "template", "stream")


class Store:
    """Segments are Parquet folders; a JSON catalog beside them holds one row for each, with its bounds and schema.

    All of it lies below root, on any file system that Spark reaches. Every folder that is written has a row in the catalog: as a
    segment, rollup or materialization, or as retired until purge() deletes it.
    """

    def __init__(self, spark: SparkSession, root: str, tenant: str, clock=time.time, cold_root: str | None = None, admission: Admission | None = None):
        self.spark, self.tenant, self.clock, self.files = spark, check_tenant(tenant), clock, Files(spark)
        self.root = join(root, self.tenant)
        self.cold = join(cold_root, self.tenant) if cold_root else None
        self.admission = admission or Admission(0)
        if is_local(root):
            os.makedirs(self.root.removeprefix("file://"), exist_ok=True)
            confined(root.removeprefix("file://"), self.root.removeprefix("file://"))
        self.catalog = join(self.root, "catalog.json")
        self.state = {"generation": 0, "metrics": [], "hot": [], "snapshot": None, "logs": {}, "landing": {}, "rollups": {}, "materialized": {}, "retired": {}, "buffered": {}, "index": None}
        if self.files.exists(self.catalog):
            self.state |= json.loads(self.files.read_text(self.catalog))

    # --- catalog -------------------------------------------------------------

    def commit(self) -> None:
        """Replaces the catalog in one step; readers see the old or the new one."""
        self.state["generation"] += 1
        self.files.write_text(self.catalog, json.dumps(self.state))

    @staticmethod
    def segments(rows: list[dict]) -> list[Segment]:
        return [Segment(**r) for r in rows]

    def folder(self, *parts: str) -> str:
        return join(self.root, *parts, uuid.uuid4().hex)

    def now_ms(self) -> int:
        return int(self.clock() * 1000)

    def retire(self, paths) -> None:
        self.state["retired"].update({p: self.now_ms() for p in paths})

    # --- ingest --------------------------------------------------------------

    def ingest_metrics(self, window: DataFrame) -> int:
        """Appends a window, stamped with now, to the hot rows; an empty one changes nothing. Gives the number of rows."""
        at = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(self.clock())) + f".{self.now_ms() % 1000:03d}"
        path = self.folder("metrics", "hot")
        rows = Observation()
        df = stamp(window, at)
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
        n = rows.get["n"]
        if not n:
            self.files.delete(path)
            return 0
        now = self.now_ms()  # all rows have this ts
        self.state["hot"].append(asdict(Segment(0, path, self.files.size(path), now, now, schema=df.schema.json())))
        self.commit()
        return n

    def land_logs(self, artifact: str, window: DataFrame) -> str | None:
        """Writes a window as it is; landed logs are searched only after refresh(). Its times are those of its rows, where they have an ingest time, and now."""
        path = self.folder("logs", check_artifact(artifact), "landing")
        rows = Observation()
        ms = F.floor(F.col(INGEST_NS) / 1_000_000) if INGEST_NS in window.columns else F.lit(None).cast("long")
        window.observe(rows, F.count(F.lit(1)).alias("n"), F.min(ms).alias("low"), F.max(ms).alias("high")).write.parquet(path)
        got = rows.get
        if not got["n"]:
            self.files.delete(path)
            return None
        now = self.now_ms()
        low, high = (now if got[x] is None else got[x] for x in ("low", "high"))
        self.state["landing"].setdefault(artifact, []).append(asdict(Segment(-1, path, self.files.size(path), min(low, now), max(high, now), schema=window.schema.json())))
        self.commit()
        return path

    def buffer_logs(self, artifact: str, window: DataFrame, most_rows: int = 100_000, most_bytes: int = 64 << 20, age_ms: int = 30_000) -> str | None:
        """Keeps small windows until they have so many rows or bytes together, or the first is so old; then they land as one, by name.

        Gives the path of what landed. Buffered windows are in the catalog, so a restart loses none; flush_logs() lands them at once.
        """
        path = self.folder("logs", check_artifact(artifact), "buffer")
        rows = Observation()
        window.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
        if not rows.get["n"]:
            self.files.delete(path)
        else:
            held = self.state["buffered"].setdefault(artifact, [])
            held.append(asdict(Segment(-1, path, self.files.size(path), self.now_ms(), self.now_ms(), schema=window.schema.json())) | {"rows": rows.get["n"]})
            self.commit()
        held = self.state["buffered"].get(artifact, [])
        full = sum(r["rows"] for r in held) >= most_rows or sum(r["bytes"] for r in held) >= most_bytes or (held and self.now_ms() - held[0]["min_ts"] >= age_ms)
        return self.flush_logs(artifact) if full else None

    def flush_logs(self, artifact: str) -> str | None:
        held = self.state["buffered"].get(artifact, [])
        if not held:
            return None
        segs = self.segments([{k: v for k, v in r.items() if k != "rows"} for r in held])
        path = self.land_logs(artifact, read_logs(self.spark, segs))
        self.state["buffered"][artifact] = []
        self.retire(s.path for s in segs)
        self.commit()
        return path

    def snapshot(self) -> None:
        """Hot rows in time order as one file set that queries read instead of them."""
        hot = self.segments(self.state["hot"])
        if not hot:
            return
        path = self.folder("metrics", "snapshot")
        read_metrics(self.spark, hot).repartitionByRange("ts").sortWithinPartitions("ts").write.parquet(path)
        self._drop_snapshot()
        self.state["snapshot"] = asdict(stat(self.spark, path, 0, self.files.size(path)))
        self.commit()

    def _drop_snapshot(self) -> None:
        if self.state["snapshot"]:
            self.retire([self.state["snapshot"]["path"]])
        self.state["snapshot"] = None

    def roll(self) -> Segment | None:
        """The hot rows become a segment of tier 0."""
        hot = self.segments(self.state["hot"])
        if not hot:
            return None
        s = lifecycle.merge_metrics(self.spark, lifecycle.Merge(tuple(hot), 0), self.root)
        self.state["metrics"].append(asdict(s))
        self.retire(x.path for x in hot)
        self._drop_snapshot()
        self.state["hot"] = []
        self.commit()
        return s

    def rebuild(self) -> int:
        """Lists the tiers' folders anew, hot and cold, for a catalog that was lost: bounds come from the files. Gives the number of segments.

        Sources that a merge retired but purge() hadn't deleted yet come back with their merged rows, so this is for an empty catalog only.
        """
        if self.state["metrics"] or self.state["logs"]:
            raise ValueError("the catalog isn't empty")
        for root in filter(None, (self.root, self.cold)):
            for path in self.files.folders(join(root, "metrics", "tiers") if root == self.root else join(root, "metrics")):
                for p in self.files.folders(path):
                    self.state["metrics"].append(asdict(stat(self.spark, p, int(path.rsplit("L", 1)[-1]), self.files.size(p))))
            for artifact in self.files.folders(join(root, "logs")):
                for path in self.files.folders(join(artifact, "tiers") if root == self.root else artifact):
                    for p in self.files.folders(path):
                        df = self.spark.read.parquet(p)
                        low, high = df.agg(F.min(INGEST_NS), F.max(INGEST_NS)).first()
                        seg = Segment(int(path.rsplit("L", 1)[-1]), p, self.files.size(p), (low or 0) // 1_000_000, (high or 0) // 1_000_000, schema=df.schema.json())
                        self.state["logs"].setdefault(artifact.rsplit("/", 1)[-1], []).append(asdict(seg))
        self.commit()
        return len(self.state["metrics"]) + sum(map(len, self.state["logs"].values()))

    # --- background work -------------------------------------------------------

    def compact(self, queue: list[Merge] | None = None, policies: list[Callable[[], Merge | None]] | None = None, catch_up: Callable[[], Merge | None] = lambda: None, materializations: list[Materialization] | None = None, **options) -> Segment | None:
        """One merge of metrics segments: one asked for in queue, else a tiered one, else one to catch up, else by policy.

        From tier 1 on the merged segment gets rollups. Its sources are retired, and so are the rollups and materializations made of them, so
        that totals over rollups count each row once however often it is merged.
        """
        segs = self.segments(self.state["metrics"])
        tiered = lambda: lifecycle.plan_merge(segs, **options)
        action = lifecycle.choose(queue if queue is not None else [], tiered, catch_up, policies or [])
        if action is None:
            return None
        merged = lifecycle.merge_metrics(self.spark, action, self.root)
        sources = {s.path for s in action.sources}
        self._retire_derived("rollups", sources)
        for name, path in lifecycle.build_rollups(self.spark, merged, self.root, STEPS).items():
            self.state["rollups"].setdefault(name, []).append({"path": path, "of": merged.path, "max_ts": merged.max_ts})
        self.state["metrics"] = [asdict(s) for s in lifecycle.retire(segs, action.sources)] + [asdict(merged)]
        self.retire(sources)
        self._materialize("metrics", action, merged, materializations or [])
        self.commit()
        return merged

    def _retire_derived(self, kind: str, sources: set[str]) -> None:
        for name, rows in self.state[kind].items():
            self.retire(r["path"] for r in rows if r["of"] in sources)
            self.state[kind][name] = [r for r in rows if r["of"] not in sources]

    def _materialize(self, plane: str, action: Merge, merged: Segment, items: list[Materialization]) -> None:
        read = read_metrics if plane == "metrics" else read_logs
        for m in items:
            if m.plane != plane or merged.tier < m.min_tier:
                continue
            path = lifecycle.materialize(self.spark, check_artifact(m.name), m.sql, read(self.spark, list(action.sources)), read(self.spark, [merged]), self.root)
            if path:  # a failing query leaves the merge and the other items alone
                gone = {s.path for s in action.sources}
                kept = self.state["materialized"].get(m.name, [])
                self.retire(r["path"] for r in kept if r["of"] in gone)
                self.state["materialized"][m.name] = [r for r in kept if r["of"] not in gone] + [{"path": path, "of": merged.path}]

    def refresh(self, artifact: str, materializations: list[Materialization] | None = None, **options) -> int:
        """Moves landed logs to the tiers as the planner asks; gives the number of merges. Sources are retired."""
        landing = self.segments(self.state["landing"].get(artifact, []))
        tiers = self.segments(self.state["logs"].get(artifact, []))
        actions = lifecycle.plan_log_merges(self.now_ms(), landing, tiers, **options)
        for a in actions:
            merged = lifecycle.merge_logs(self.spark, a, self.root, artifact, a.sources[0].min_ts * 1_000_000)
            landing = [s for s in landing if s not in a.sources]
            tiers = [s for s in tiers if s not in a.sources] + [merged]
            self.retire(s.path for s in a.sources)
            self._materialize("logs", a, merged, materializations or [])
        self.state["landing"][artifact] = [asdict(s) for s in landing]
        self.state["logs"][artifact] = [asdict(s) for s in tiers]
        if actions:
            self._write_index()
        self.commit()
        return len(actions)

    def expire(self, keep_ms: int = 15 * 86_400_000, most_landing: int | None = None) -> int:
        """Retires what ended more than keep_ms ago: metrics, rollups by their newest bucket, logs landed and in tiers; then the oldest landed files over a cap."""
        now, before = self.now_ms(), len(self.state["retired"])

        def keep(rows: list[dict], cap: int | None = None) -> list[dict]:
            segs = self.segments(rows)
            gone = lifecycle.expired([s for s in segs if not s.compacted], now, keep_ms)
            left = [s for s in segs if s not in gone]
            over = lifecycle.over_cap(left, cap) if cap is not None else []
            self.retire(s.path for s in [*gone, *over])
            return [asdict(s) for s in left if s not in over]

        self.state["metrics"] = keep(self.state["metrics"])
        for a in self.state["logs"]:
            self.state["logs"][a] = keep(self.state["logs"][a])
        for a in self.state["landing"]:
            self.state["landing"][a] = keep(self.state["landing"][a], most_landing)
        for name, rows in self.state["rollups"].items():
            old = [r for r in rows if r["max_ts"] < now - keep_ms]
            self.retire(r["path"] for r in old)
            self.state["rollups"][name] = [r for r in rows if r not in old]
        self.commit()
        return len(self.state["retired"]) - before

    def purge(self, grace_ms: int) -> list[str]:
        """Deletes retired folders whose grace is over; their rows leave the catalog first, so that no query opens them any more."""
        out = lifecycle.purge(self.state["retired"], self.now_ms(), grace_ms)
        self.state["metrics"] = [s for s in self.state["metrics"] if s["path"] not in out]
        for p in out:
            self.state["retired"].pop(p)
        self.commit()
        for p in out:
            self.files.delete(p)
        return out

    def promote(self, age_ms: int = 12 * 3_600_000) -> list[Segment]:
        """Copies segments of tier 1 or more that are old enough to the cold root, each checked there; then the catalog points to the copy and the source is
        retired. A copy that fails leaves its source as it is, for a later call. Without a cold root nothing happens."""
        moved = []
        if not self.cold:
            return moved
        planes = [("metrics", self.state["metrics"])] + [(f"logs/{a}", rows) for a, rows in sorted(self.state["logs"].items())]
        for plane, rows in planes:
            for s in lifecycle.promotable(self.segments(rows), self.now_ms(), age_ms):
                if s.path.startswith(self.cold):
                    continue
                try:
                    new = lifecycle.promote(self.spark, s, join(self.cold, plane))
                except (OSError, Py4JJavaError):
                    continue
                rows[[r["path"] for r in rows].index(s.path)] = asdict(new)
                self.retire([s.path])
                self.commit()
                moved.append(new)
        return moved

    def materialize(self, name: str, sql: str) -> bool:
        """Runs a materialization over all metrics as merge_input and merge_output, in place of what it held before."""
        m = self.metrics()
        path = lifecycle.materialize(self.spark, check_artifact(name), sql, m, m, self.root)
        if path:
            self.retire(r["path"] for r in self.state["materialized"].get(name, []))
            self.state["materialized"][name] = [{"path": path, "of": ""}]
            self.commit()
        return path is not None

    # --- relations and queries ---------------------------------------------------

    def opened(self, start: int | None = None, end: int | None = None, auto_hot: bool = False) -> list[Segment]:
        """The segments that a query of [start, end) opens."""
        hot = [Segment(**self.state["snapshot"])] if self.state["snapshot"] else self.segments(self.state["hot"])
        tiers = self.segments(self.state["metrics"])
        if auto_hot and self.state["snapshot"] and start is not None and end is not None:
            return prune(hot_only(tiers, start, end, hot[0]), start, end)
        return prune([*tiers, *hot], start, end)

    def metrics(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return read_metrics(self.spark, self.opened(start, end))

    def rollups(self, step: str) -> DataFrame | None:
        paths = [r["path"] for r in self.state["rollups"].get(step, [])]
        return self.spark.read.parquet(*paths) if paths else None

    def logs(self, artifact: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        frames = [read_logs(self.spark, prune(self.segments(s), start, end)) for a, s in sorted(self.state["logs"].items()) if artifact in (None, a)]
        out = union_by_name(frames) if frames else empty(self.spark, f"message string, format string, template string, count bigint, {INGEST_NS} bigint")
        return out if INGEST_NS in out.columns else out.withColumn(INGEST_NS, F.lit(None).cast("long"))

    def range(self, start: str, end: str, step: str = "", with_rollups: bool = False) -> DataFrame:
        seconds = [F.lit(x).cast("timestamp") for x in (start, end)]
        low, high = self.spark.range(1).select(*[F.unix_seconds(s) for s in seconds]).first()
        picked = pick_step(low, high, step) if with_rollups else ""
        return range_query(self.metrics(low * 1000, high * 1000 + 1), start, end, self.rollups(picked) if picked else None)

    def promql(self, expr: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
        """Opens the segments of the range widened by the lookback and the longest range in the expression."""
        return promql.query_range(self.metrics(start_ms - widest(promql.parse(expr)), end_ms + 1), expr, start_ms, end_ms, step_ms)

    def _log_range(self, start_ns: int | None, end_ns: int | None, lookback_ms: int) -> tuple[DataFrame, int | None]:
        """The log segments that may hold rows of the range, and its start; an open start goes back by lookback_ms, if that is set."""
        start = recent_floor(start_ns // 1_000_000 if start_ns else 0, self.now_ms(), lookback_ms) or None
        end = None if end_ns is None else end_ns // 1_000_000 + 1
        floor = None if start is None else max(start_ns or 0, start * 1_000_000)
        return self.logs(None, start, end), floor

    def logql(self, query: str, start_ns: int | None = None, end_ns: int | None = None, lookback_ms: int = 0, **options) -> DataFrame:
        """Streams with their entries, as many as the limit at most. Opens the log segments that may hold rows of the range."""
        logs, floor = self._log_range(start_ns, end_ns, lookback_ms)
        return logql.streams(logql.query_rows(logs, query, floor, end_ns, **options))

    def logql_rows(self, query: str, start_ns: int | None = None, end_ns: int | None = None, lookback_ms: int = 0) -> DataFrame:
        """(stream, ts_ns, line) of all rows that logql() chooses from, without its limit."""
        logs, floor = self._log_range(start_ns, end_ns, lookback_ms)
        return logql.all_rows(logs, query, floor, end_ns)

    def _views(self, start: int | None, end: int | None) -> dict[str, DataFrame]:
        logs = {a: prune(self.segments(s), start, end) for a, s in self.state["logs"].items()}
        tables = {n: [r["path"] for r in rows] for n, rows in self.state["materialized"].items() if rows}
        return tenant_views(self.spark, self.opened(start, end), logs, tables)

    def sql(self, text: str, row_cap: int = sqlapi.ROW_CAP, start: int | None = None, end: int | None = None) -> DataFrame:
        """start and end (milliseconds) only choose which segments are opened."""
        return sqlapi.run_sql(self.spark, text, self._views(start, end), row_cap)

    def sql_page(self, text: str, row_cap: int = sqlapi.ROW_CAP, seconds: float | None = 30.0, start: int | None = None, end: int | None = None) -> tuple[list, bool]:
        """(rows, truncated), behind the store's admission and cancelled after so many seconds."""
        with self.admission.place():
            df = self.sql(text, row_cap, start, end)
            return within_time(df.sparkSession, lambda: sqlapi.page(df, row_cap), seconds)

    def _write_index(self) -> None:
        """(label, label_value) of the indexed columns of all logs in tiers, as a small table."""
        df = self.logs()
        out = self.spark.createDataFrame([("job", logql.JOB)], "label string, label_value string")
        has = [c for c in INDEXED if c in df.columns]
        if has:
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("label_value")) for c in has]))
            out = out.union(df.select(pairs.alias("p")).select("p.*").where("label_value <> ''").distinct())
        path = self.folder("logs-index")
        out.write.parquet(path)
        if self.state["index"]:
            self.retire([self.state["index"]])
        self.state["index"] = path

    def label_index(self) -> DataFrame:
        """(label, label_value): written anew when logs come to the tiers, so it may name values of rows that expired since."""
        if not self.state["index"]:
            self._write_index()
            self.commit()
        return self.spark.read.parquet(self.state["index"])

    def log_label_values(self, name: str, query: str | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        """(label_value): from the index without a selector and range, else from the rows."""
        if name in ("job", *INDEXED) and query is None and start_ns is None and end_ns is None:
            return self.label_index().where(F.col("label") == name).select("label_value").orderBy("label_value")
        rows = self.logs(None, None if start_ns is None else start_ns // 1_000_000, None if end_ns is None else end_ns // 1_000_000 + 1)
        return logql.label_values(rows, name, query or "", start_ns, end_ns)

    def stats(self) -> dict:
        """Bytes and segments by plane, and metrics bytes by tier."""
        count = lambda rows: {"segments": len(rows), "bytes": sum(r["bytes"] for r in rows)}
        return {"generation": self.state["generation"], "metrics": count(self.state["metrics"]), "tiers": bytes_on_disk(self.segments(self.state["metrics"])), "hot": count(self.state["hot"]), "logs": {a: count(r) for a, r in self.state["logs"].items()}, "landing": {a: count(r) for a, r in self.state["landing"].items()}, "queries": dict(self.admission.counts)}


def exposition(stats: dict, tenant: str) -> list[str]:
    """A store's stats as exposition lines, for a scrape of the store itself."""
    out = [f'tidemark_catalog_generation{{tenant="{tenant}"}} {stats["generation"]}']
    planes = {"metrics": stats["metrics"], "hot": stats["hot"], **{f"logs/{a}": s for a, s in stats["logs"].items()}, **{f"landing/{a}": s for a, s in stats["landing"].items()}}
    for kind in ("segments", "bytes"):
        out += [f'tidemark_{kind}{{plane="{p}",tenant="{tenant}"}} {s[kind]}' for p, s in sorted(planes.items())]
    return out + [f'tidemark_queries_total{{result="{k}",tenant="{tenant}"}} {n}' for k, n in sorted(stats["queries"].items())]


def widest(node, lookback: int = 300_000) -> int:
    """Milliseconds before a step that an expression may read: ranges, subqueries and offsets along the longest path."""
    own = getattr(node, "range_ms", None) or 0
    offset = getattr(node, "offset_ms", 0)
    below = [getattr(node, a) for a in ("expr", "left", "right", "param") if getattr(node, a, None) is not None] + list(getattr(node, "args", []))
    return max([lookback, *(widest(x) for x in below if hasattr(x, "__dataclass_fields__"))]) + own + max(offset, 0)


def reconcile(raw: DataFrame, written: DataFrame, summaries: DataFrame) -> dict[str, bool]:
    """Whether the rows written and the counts of the summaries agree with the raw rows."""
    n = raw.count()
    return {"written": written.count() == n, "summaries": (summaries.agg(F.sum("count")).first()[0] or 0) == n}

