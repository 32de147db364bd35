"""Map sessions: the API a map front end calls, over cached tables.

A session holds one query's objects (its rows joined with the geometry dictionary), as tables in the shared folder:
a lost executor costs no rows and changes no row id, and a lost driver no session: any engine over the same folder finds, uses
and ends it. Objects are written along a space-filling curve, so that a click or a view reads a small part of them. The levels that
coarse maps draw are made at the first such map and kept too. Queries are Spark SQL texts or DataFrames whose last column is the geometry: WKT, or an id of the
dictionary or of a folded point.
"""

from __future__ import annotations

import json
import math
import re
import secrets
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import mercator
from ..operators import cluster, grid, ingest, lookup, match, raster
from ..sources import registry, sinks, tables
from ..sources.dictionary import Versions
from ..sources.sessions import Sessions


class NotReady(LookupError):
    """No such session."""


class TooLarge(MemoryError):
    """A query has more objects than the configuration allows."""


@dataclass
class Config:
    """cache_dir: where dictionaries are saved. lifetime_min: age at which sessions end. auto_threshold: objects above which heat maps are drawn. most_objects: the largest query taken. buckets: files of a saved dictionary."""

    cache_dir: str | None = None
    lifetime_min: float = 360.0
    auto_threshold: int = 1000
    most_objects: int | None = None
    buckets: int = 64


@dataclass
class Session:
    result: DataFrame
    objects: DataFrame
    num_objects: int
    box: tuple
    made: float
    levels: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def origin(self) -> tuple[float, float]:
        """Where the session's grids begin."""
        return (self.box[0], self.box[1]) if self.box[0] is not None else (0.0, 0.0)


#: Rows whose matches are looked at before a large query is taken; log2 of the sketch's registers; standard errors allowed.
ADMITTED, LG_REGISTERS, ERRORS = 100_000, 12, 4


class MapEngine:
    def __init__(self, spark: SparkSession, config: Config | None = None, fills: registry.Registry | None = None):
        self.spark, self.config, self.fills = spark, config or Config(), fills or registry.Registry()
        self.dictionaries: dict[str, tuple[str, DataFrame]] = {}
        self.shared = Sessions(spark)
        self.sessions: dict[str, Session] = {}
        self.stages: dict[str, int] = {}
        self.loaded: dict[str, dict[str, int]] = {}

    # dictionaries

    def load(self, backend: str) -> DataFrame:
        """The backend's dictionary: in memory if its source is as it was, else from the cache, else built."""
        source = self.fills.resolve(backend)(self.spark)
        version = registry.fingerprint(source)
        if backend in self.dictionaries and self.dictionaries[backend][0] == version:
            return self.dictionaries[backend][1]
        self.stages[backend] = 1
        sc, group = self.spark.sparkContext, self._group(backend)
        sc.setJobGroup(group, f"load {backend}")
        try:
            saved = Versions(self.spark, f"{self.config.cache_dir}/{backend or 'default'}", self.config.buckets) if self.config.cache_dir else None
            made = saved.read(version) if saved else None
            self.stages[backend] = 3 if made is not None else 2
            if made is None:
                seen = Observation()
                built = ingest.build_dictionary(registry.without_folded(source), known=saved.read() if saved else None)
                built = built.observe(seen, F.count(F.lit(1)).alias("components"), F.count_if(F.col("kind") == "NONE").alias("unreadable"))
                made = saved.save(built, version) if saved else tables.keep(built, "dictionary")
                self.loaded[backend] = seen.get
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        if backend in self.dictionaries:
            tables.forget(self.dictionaries[backend][1])
        self.dictionaries[backend] = (version, made)
        self.stages[backend] = 4
        return made

    def _group(self, backend: str) -> str:
        return f"mapfold-load-{id(self)}-{backend}"

    def load_status(self, backend: str) -> dict:
        """stage: 1 parse, 2 build, 3 from cache, 4 finished. percent: tasks that are through, of those known so far. Totals of what was built."""
        stage, tracker = self.stages.get(backend, 0), self.spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self._group(backend))] if stage in (1, 2, 3) else []
        stages = [tracker.getStageInfo(i) for j in jobs if j for i in j.stageIds]
        done, all_ = (sum(getattr(i, c) for i in stages if i) for c in ("numCompletedTasks", "numTasks"))
        return {"percent": 100.0 if stage == 4 else 100.0 * done / all_ if all_ else 0.0, "stage": stage, **self.loaded.get(backend, {})}

    # queries

    def query(self, query: str | DataFrame, backend: str | None = None) -> dict:
        """Runs a query once and keeps its objects; the same text again gives the same session, in any engine, unless it holds rand().

        A column row_id, if there is one, tells rows apart: it must hold a value of its own for each. Without it, rows are numbered.
        """
        self.evict()
        version = self.dictionaries[backend][0] if backend and self.load(backend) is not None else ""
        key = (backend or "", version, query) if isinstance(query, str) and not re.search(r"\b(rand|randn|uuid|shuffle)\s*\(", query, re.I) else None
        if key and (name := self.shared.of_query(key)):
            return self.describe(name)
        result = self.spark.sql(query) if isinstance(query, str) else query
        name = str(secrets.randbits(63))
        try:
            self._make(name, result, backend)
        except BaseException:
            self.shared.end(name)
            raise
        if key:
            self.shared.remember(key, name)
        return self.describe(name)

    def _make(self, name: str, result: DataFrame, backend: str | None) -> None:
        numbered = "row_id" in result.columns
        if not numbered:
            result = result.select(F.monotonically_increasing_id().alias("row_id"), *[f"`{c}`" for c in result.columns])
        folder = self.shared.at(name)
        result = tables.keep(result, "result", folder)  # fixes the row ids
        if numbered and result.groupBy("row_id").count().where("count > 1 or row_id is null").take(1):
            raise ValueError("row_id must hold a value of its own for each row")
        geometry = ingest.last_column(result)
        if dict(result.dtypes)[geometry] == "string":
            self._admit(result.count())  # rows whose geometry can't be read count
            objects = ingest.project(ingest.decode(result, "row_id", geometry)).withColumns({"row_id": F.col("qid"), "weights": ingest.weights_of()})
        else:
            keyed = result.select("row_id", F.col(geometry).alias("qid"))
            dictionary = self.load(backend) if backend else None
            self._admit(keyed.count(), keyed, dictionary)
            objects = match.all_objects(keyed, dictionary) if backend else match.as_components(match.folded_points(keyed))
        middle = grid.morton((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2)
        objects = tables.keep(objects, "objects", folder, along=middle)
        n = match.count_objects(objects).first()[0]
        self._admit(n)
        self.shared.put(name, {"result": result, "objects": objects}, num_objects=n, box=list(match.bounds(objects).first()))

    def _admit(self, rows: int, keyed: DataFrame | None = None, dictionary: DataFrame | None = None) -> None:
        """Raises TooLarge if a query has too many objects: so many rows or, of rows with ids, by a sketch of those of a sample that match.

        The sample is a hash's part of the row ids. It decides only what lies beyond its error; what is nearer is counted once it is joined.
        """
        most = self.config.most_objects
        if most is None or rows <= most:
            return
        if keyed is None:
            raise TooLarge(f"{rows} objects")
        part = max(1, rows // ADMITTED)
        sample = keyed.where(F.pmod(F.xxhash64(F.lit("admit"), "row_id"), F.lit(part)) == 0)
        seen = match.folded_points(sample).select("row_id")
        if dictionary is not None:
            seen = seen.unionByName(sample.join(dictionary.select("qid"), "qid", "left_semi").select("row_id"))
        about, n = seen.agg(F.hll_sketch_estimate(F.hll_sketch_agg("row_id", LG_REGISTERS)), F.count(F.lit(1))).first()
        error = ERRORS * math.hypot(1.04 / math.sqrt(1 << LG_REGISTERS), math.sqrt((part > 1) / max(n, 1)))
        if about * part > most * (1 + error):
            raise TooLarge(f"about {about * part} objects")

    def describe(self, session: str) -> dict:
        s = self.get(session)
        return sinks.query_json(session, s.box, s.num_objects, self.config.auto_threshold)

    def get(self, session: str) -> Session:
        """A session of this engine or of another one over the same folder."""
        if session not in self.sessions:
            found = self.shared.find(session)
            if found is None:
                raise NotReady(session)
            made, facts = found
            self.sessions[session] = Session(made["result"], made["objects"], facts["num_objects"], tuple(facts["box"]), facts["made"])
        elif not self.shared.store.exists(f"{self.shared.at(session)}/manifest"):  # ended by another engine
            del self.sessions[session]
            raise NotReady(session)
        return self.sessions[session]

    def clear(self, session: str | None = None) -> int:
        """Ends one session or all of this engine."""
        names = [session] if session else list(self.sessions)
        for name in names:
            self.sessions.pop(name, None)
            self.shared.end(name)
        return len(names)

    def evict(self, now: float | None = None) -> None:
        """Ends the sessions that are over their lifetime, whoever made them."""
        for name in self.shared.expired(60 * self.config.lifetime_min, now):
            self.clear(name)

    # answers

    def style(self, session: str, zoom: float, wanted: str = "auto") -> str:
        if wanted != "auto":
            return "objects" if wanted == "objects" else "heatmap"
        return "heatmap" if zoom <= 15 and self.get(session).num_objects > self.config.auto_threshold else "objects"

    def raster(self, session: str, view: raster.Viewport, style: str = "heatmap") -> DataFrame:
        """(px, py, r, g, b, a) of a view."""
        s = self.get(session)
        heat = lambda: raster.heatmap(s.objects, view, *s.origin, self.levels(session) if view.level != "exact" else None)
        if style != "objects":
            return raster.colour_heat(raster.normalise(raster.stamp(heat(), view)))
        if view.level != "exact":
            return raster.colour_objects(raster.stamp(heat().withColumn("weight", F.lit(1.0)), view))
        shown = self.clusters(session, view.resolution)
        drawn = raster.clusters_as_objects(shown, view)
        lines = raster.leaders(shown, view).withColumn("weight", F.lit(0.6))
        outlines = raster.lines_exact(s.objects.where("kind in ('LINE', 'AREA')"), view)
        return raster.colour_objects(raster.merge(drawn, lines, outlines))

    def levels(self, session: str) -> dict[str, DataFrame]:
        """The session's levels: made once, read by every map but exact ones, a part of each by cell."""
        s = self.get(session)
        if not s.levels:
            s.levels = self.shared.find_levels(session)
        if not s.levels:
            folder = self.shared.at(session)
            curve = grid.morton(F.col("cell_x").cast("double"), F.col("cell_y").cast("double"), 0.0, float(1 << 20))
            keep = lambda made: {name: tables.keep(df, name, folder, along=curve) for name, df in made.items()}
            fine = keep({name: df for name, df in raster.levels_of(s.objects, *s.origin).items() if name in ("spots", "subs")})
            s.levels = self.shared.put_levels(session, fine | keep(raster.coarser(fine["spots"], fine["subs"])))
        return s.levels

    def heatmap_png(self, session: str, bbox: str, width: int, height: int, style: str = "heatmap") -> bytes:
        view = raster.Viewport.parse(bbox, width, height)
        return sinks.png(self.raster(session, view, style).collect(), view.width, view.height)  # at most width x height rows

    def clusters(self, session: str, res: float) -> DataFrame:
        points = self.get(session).objects.where("kind = 'POINT'")
        single = points.groupBy("row_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("row_id")
        one = cluster.cluster(points.join(single, "row_id").select("row_id", "x", "y"), ("x", "y"))
        many = points.join(single, "row_id", "left_anti").select("row_id", "x", "y", F.lit(0).cast("long").alias("cl_tot"), F.lit(0).cast("long").alias("cl_num"))
        return cluster.displaced(one.unionByName(many), res)

    def nearest(self, session: str, x: float, y: float, rad: float, view: raster.Viewport | None = None, style: str = "heatmap", k: int = 1) -> list[dict]:
        """The nearest objects with attributes, position in degrees and simplified geometry; [] if none is near."""
        s = self.get(session)
        points = s.objects.where("kind = 'POINT'")
        if view and style == "objects" and view.level == "exact":
            points = lookup.visible_points(self.clusters(session, view.resolution), view)
        hits = lookup.nearest(points, s.objects.where("kind in ('LINE', 'AREA')"), x, y, rad, k)
        hits = hits.withColumns({"lng": mercator.lng_of(F.col("hit_x")), "lat": mercator.lat_of(F.col("hit_y"))}).collect()  # k rows
        if not hits:
            return []
        # attributes and geometry of all hits, in one plan
        ids = F.col("row_id").isin([h["row_id"] for h in hits])
        parts = lookup.geometries_of(s.objects.where(ids), rad).withColumn("coords", sinks.unproject(F.col("coords")))
        found = s.result.where(ids).join(sinks.geojson_by_row(parts).withColumnRenamed("feature", "__feature"), "row_id", "left").collect()
        rows = {r["row_id"]: r.asDict() for r in found}
        shown = lambda r: [[c, v] for c, v in r.items() if c not in ("row_id", "__feature")]
        return [{"id": h["row_id"], "attrs": shown(rows[h["row_id"]]), "ll": {"lat": h["lat"], "lng": h["lng"]}, "geom": json.loads(rows[h["row_id"]]["__feature"])} for h in hits]

    def row(self, session: str, row_id: int) -> dict:
        found = match.row_of(self.get(session).result, row_id).first()
        return {} if found is None else {c: v for c, v in found.asDict().items() if c != "row_id"}

    def geojson(self, session: str, row_id: int, rad: float, export: bool = False) -> str:
        """A row's geometry as a Feature in degrees; with export, its attributes are properties."""
        s = self.get(session)
        parts = lookup.geometry_of(s.objects, row_id, rad).withColumn("coords", sinks.unproject(F.col("coords")))
        properties = None
        if export:
            row = {k: v for k, v in list(self.row(session, row_id).items())[:-1]}
            properties = F.lit(json.dumps(row, default=str))
        return sinks.geojson_of_parts(parts, properties).first()["feature"]

    def export(self, session: str, path: str, kind: str = "geojson") -> None:
        """All rows of the session's result, written in parallel: geojson, tsv or csv."""
        result = self.get(session).result.drop("row_id")
        if kind == "geojson":
            sinks.write_geojson(result, path)
        elif kind in ("tsv", "csv"):
            sinks.write_delimited(result, path, "\t" if kind == "tsv" else ",")
        else:
            raise ValueError(kind)
