"""Tables of the index under one folder: Parquet, appended by stage; index days are overwritten as partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bullgauge.functions.stance import score_segment
from bullgauge.operators import levels, segmenting, votes
from bullgauge.settings import DEFAULT, Settings
from bullgauge.sources import inbox, parsing

TABLES = {
    "orgs": ("org_name string", []),
    "notes": (inbox.SCHEMA, ["trade_date"]),
    "note_text": (parsing.SCHEMA, []),
    "segments": ("file_md5 string, product_code string, product_name string, sector string, raw_text string, advice_text string, seq int", []),
    "scores": ("file_md5 string, seq int, direction double, confidence double, evidence string, method string, attempt long, model_version string", ["model_version"]),
    "daily_index": ("trade_date date, level string, key string, net_score double, bull_count long, bear_count long, neutral_count long, coverage_count long, updated_at timestamp, calc_version string, model_version string", ["calc_version", "model_version", "trade_date"]),
}


class Store:
    """Stages find their own work by anti-joins, so running one again adds nothing."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULT):
        self.spark, self.root, self.s = spark, root.rstrip("/"), settings

    def _path(self, name: str):
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def table(self, name: str) -> DataFrame:
        path, schema = self._path(name), TABLES[name][0]
        system, p = self._fs(path)
        if not system.exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def count(self, name: str) -> int:
        return self.table(name).count()

    def reset(self) -> None:
        system, p = self._fs(self.root)
        system.delete(p, True)

    def _append(self, name: str, rows: DataFrame) -> int:
        """Rows written, counted while they are."""
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*TABLES[name][1]).parquet(self._path(name))
        return seen.get["n"]

    # -------------------------------------------------------------- stages
    def ingest(self, folder: str, channel: str = "inbox", now: str | None = None) -> dict[str, int]:
        names, skipped = inbox.list_folder(self.spark, folder)
        rows = inbox.notes(inbox.scan(self.spark, folder), channel, now)
        empty = len(names) - rows.filter("parse_status = 'pending'").count()  # listings of Spark leave empty files out
        new = self._append("notes", inbox.new_notes(rows, self.table("notes")))
        houses = self.table("notes").select("org_name").distinct()
        self._append("orgs", houses.join(self.table("orgs"), "org_name", "left_anti"))  # a house is entered when its first note is
        return {"new": new, "duplicated": len(names) - empty - new, "failed": empty, "skipped_format": len(skipped)}

    def parse(self) -> dict[str, int]:
        todo = self.table("notes").join(self.table("note_text").select("file_md5"), "file_md5", "left_anti")
        self._append("note_text", parsing.parse_paths(todo.select("file_md5", F.col("file_path").alias("path")), self.s))
        return parsing.parse_counts(self.table("note_text")).first().asDict()

    def segment(self) -> dict[str, int]:
        """Counts of this run: notes, blocks, those on a product, macro ones, those that several products share, notes without a block."""
        notes = self.table("note_text").filter("parse_status = 'ok'")
        todo = notes.join(self.table("segments").select("file_md5").distinct(), "file_md5", "left_anti")
        asked, made = Observation(), Observation()
        found = segmenting.segment_notes(todo.observe(asked, F.count(F.lit(1)).alias("n")), "file_md5", "parsed_text", self.s)
        product = F.col("product_code").isNotNull()
        counts = {"product": F.count_if(product), "macro": F.count_if(~product), "multi": F.count_if(F.col("raw_text").startswith("[多品种合并块")), "filled": F.count_if(F.col("seq") == 0)}
        n = self._append("segments", found.observe(made, *(c.alias(k) for k, c in counts.items())))
        got = made.get
        return {"reports": asked.get["n"], "segments": n, "product": got["product"], "macro": got["macro"], "multi": got["multi"], "empty": asked.get["n"] - got["filled"]}

    def score(self, model_version: str | None = None) -> dict[str, int]:
        version = model_version or self.s.score_version
        done = self.table("scores").filter(F.col("model_version") == version).select("file_md5", "seq")
        todo = self.table("segments").join(done, ["file_md5", "seq"], "left_anti")
        r = score_segment(F.col("advice_text"), F.col("raw_text"), self.s)
        rows = todo.select("file_md5", "seq", r.alias("r")).select("file_md5", "seq", "r.direction", "r.confidence", "r.evidence", F.lit("rule").alias("method"), F.lit(1).cast("long").alias("attempt"), F.lit(version).alias("model_version"))
        n = self._append("scores", rows)
        hit = self.table("scores").filter((F.col("model_version") == version) & (F.col("confidence") > 0)).count()
        return {"scored": n, "hit": hit}

    def score_counts(self, model_version: str | None = None) -> dict[str, float]:
        """Of a version's scores: total, hit, miss, hit rate, low confidence, bull, bear, neutral."""
        rows = self.table("scores").filter(F.col("model_version") == (model_version or self.s.score_version))
        hit, d = F.col("confidence") > 0, F.col("direction")
        got = rows.agg(
            F.count("*").alias("total"), F.count_if(hit).alias("hit"), F.count_if(~hit).alias("miss"), F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count("*")), F.lit(0.0)).alias("hit_rate"), F.count_if(hit & (F.col("confidence") < self.s.low_confidence)).alias("low_confidence"),
            F.count_if(hit & (d > self.s.bull_cutoff)).alias("bull"), F.count_if(hit & (d < self.s.bear_cutoff)).alias("bear"), F.count_if(hit & d.between(self.s.bear_cutoff, self.s.bull_cutoff)).alias("neutral"),
        )
        return got.first().asDict()

    def votes(self) -> tuple[DataFrame, DataFrame]:
        """(readable rows, votes) of all days and versions."""
        notes = self.table("notes").select("file_md5", "org_name", "title", "publish_time", "ingest_time", "trade_date")
        last = self.table("scores").groupBy("file_md5", "seq", "model_version").agg(F.max_by(F.struct("direction", "confidence", "evidence"), "attempt").alias("s")).select("file_md5", "seq", "model_version", "s.*")
        rows = self.table("segments").select("file_md5", "seq", "product_code", "sector").join(last, ["file_md5", "seq"]).join(notes, "file_md5")
        rows = votes.readable(rows.withColumnsRenamed({"file_md5": "report_id", "seq": "segment_id"}))
        return rows, votes.one_vote(rows)

    def aggregate(self) -> dict[str, int]:
        """All days of this calculation version in one job; a day of which all votes vanished loses its rows, as the version's folder is written anew; other calculation versions stay."""
        _, ballot = self.votes()
        rows = levels.index_levels(ballot, self.s).withColumn("updated_at", F.current_timestamp())
        cols = [c.strip().split(" ")[0] for c in TABLES["daily_index"][0].split(",")]
        rows.select(*(c for c in cols if c != "calc_version")).write.mode("overwrite").partitionBy("model_version", "trade_date").parquet(f"{self._path('daily_index')}/calc_version={self.s.calc_version}")
        return {"index_rows": self.count("daily_index")}

    def pipeline(self) -> dict[str, dict[str, int]]:
        return {"parse": self.parse(), "segment": self.segment(), "score": self.score(), "aggregate": self.aggregate()}

    def index(self, model_version: str | None = None, calc_version: str | None = None) -> DataFrame:
        m, c = model_version or self.s.score_version, calc_version or self.s.calc_version
        return self.table("daily_index").filter((F.col("model_version") == m) & (F.col("calc_version") == c))

    def read_index(self, date: str | None = None, level: str | None = None, model_version: str | None = None, calc_version: str | None = None) -> DataFrame:
        """Index rows of a day and level (or all), by day, level, falling net score and key."""
        rows = self.index(model_version, calc_version)
        if date:
            rows = rows.filter(F.col("trade_date") == F.lit(date).cast("date"))
        if level:
            rows = rows.filter(F.col("level") == level)
        return rows.orderBy("trade_date", "level", F.desc("net_score"), "key")


def score_with_model(text: str) -> dict:
    """Adapter point for a scoring model beside the rules; its evidence must be a part of the text."""
    raise NotImplementedError("no scoring model is configured")
