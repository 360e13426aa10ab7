"""The batch pipeline as a lazily built chain of stages."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import layout, provenance, roles, search, segment, speakers, text, topics, turns
from ..sources import adapter
from ..sources.artifacts import exists, keep, new_folder, remove, version


#: Runs of this application by input folder and configuration, with the version of the input that they have read.
_RUNS: dict[tuple, tuple] = {}


class Transcripts:
    """Stages from words and page texts to the topic index.

    Rows, pages, lines, units and topics are kept as tables, like the artifacts of a run; each is made once, by the first
    query that needs it, and read by the others. `drop` removes them.
    """

    def __init__(self, words: DataFrame, texts: DataFrame, config: EngineConfig = EngineConfig(), decisions: DataFrame | None = None):
        self.words, self.texts, self.config, self.decisions = words, texts, config, decisions

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, **more) -> Transcripts:
        printed = adapter.numbered_lines(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
        made = cls(adapter.word_boxes(printed), adapter.page_texts(printed), **more)
        made.printed = printed
        return made

    @classmethod
    def run(cls, spark: SparkSession, sf_dir: str, config: EngineConfig = EngineConfig()) -> Transcripts:
        """The run of this application over an input, begun anew if the input has changed since."""
        app = spark.sparkContext.applicationId
        key, now = (app, sf_dir, config), version(spark, f"{sf_dir}/conversations.parquet")
        for old in [k for k in _RUNS if k[0] != app]:
            del _RUNS[old]
        if key in _RUNS and not _RUNS[key][1].there(spark):
            del _RUNS[key]
        if key not in _RUNS or _RUNS[key][0] != now:
            _RUNS[key] = now, cls.of(spark, sf_dir, config=config)
        return _RUNS[key][1]

    def there(self, spark: SparkSession) -> bool:
        """Whether the kept tables still exist, as far as there are any."""
        return not getattr(self, "folder", None) or exists(spark, self.folder)

    def keep(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        self.folder = getattr(self, "folder", None) or new_folder(df.sparkSession)
        return keep(df, self.folder, name, by)

    def step(self, df: DataFrame) -> DataFrame:
        """Keeps a table that only the next steps of a stage read."""
        self.steps = getattr(self, "steps", 0) + 1
        return self.keep(df, f"step-{self.steps}")

    def drop(self) -> None:
        """Removes the kept tables; the run can't be read afterwards, and the next one over its input begins anew."""
        for k in [k for k, (_, run) in _RUNS.items() if run is self]:
            del _RUNS[k]
        if getattr(self, "folder", None):
            remove(self.words.sparkSession, self.folder)

    @cached_property
    def rows(self) -> DataFrame:
        """Visual rows without the words in their columns, which only the queries on columns read, out of the words themselves."""
        return self.keep(layout.rows(self.words).drop("words", "left", "body_all", "stamps"), "rows")

    @cached_property
    def pages(self) -> DataFrame:
        return self.keep(roles.classify(self.texts, self.rows), "pages")

    @cached_property
    def canonical(self) -> DataFrame:
        return roles.canonical_lines(self.rows, self.pages)

    @cached_property
    def lines(self) -> DataFrame:
        return self.keep(speakers.transcript(self.canonical).drop("cue"), "lines")

    @cached_property
    def turns(self) -> DataFrame:
        return turns.turns(self.lines)

    @cached_property
    def kept_turns(self) -> DataFrame:
        return self.keep(self.turns, "turns")

    @cached_property
    def units(self) -> DataFrame:
        return turns.units(self.kept_turns)

    @cached_property
    def numbered(self) -> DataFrame:
        return self.keep(turns.number_chunks(self.units, self.config, self.step), "numbered")

    @cached_property
    def chunks(self) -> DataFrame:
        return turns.chunks(self.numbered)

    @cached_property
    def kept_chunks(self) -> DataFrame:
        return self.keep(self.chunks, "chunks")

    @cached_property
    def weights(self) -> DataFrame:
        return self.keep(segment.chunk_weights(self.kept_chunks, self.config), "weights")

    @cached_property
    def long(self) -> DataFrame:
        """Transcripts that are not compared at once, but by joins over their terms."""
        return self.keep(segment.long_transcripts(self.kept_chunks), "long")

    @cached_property
    def gram(self) -> DataFrame:
        """Products of all chunks of the other transcripts."""
        return self.keep(segment.short_gram(self.kept_chunks, self.long, self.config), "gram")

    @cached_property
    def long_chunks(self) -> DataFrame | None:
        return None if self.long.isEmpty() else self.kept_chunks.join(self.long, "transcript_id", "left_semi")

    @cached_property
    def long_weights(self) -> DataFrame:
        return self.keep(segment.chunk_weights(self.long_chunks, self.config), "long_weights")

    @cached_property
    def band(self) -> DataFrame:
        """Products of the chunks that a topic can hold together; the walk needs no others."""
        found = segment.band_of(self.kept_chunks, self.gram, self.config)
        if self.long_chunks is not None:
            found = found.unionByName(segment.band_gram(self.long_chunks, self.long_weights, self.config))
        return self.keep(found, "band")

    def chunk_gram(self) -> DataFrame:
        return self.gram if self.long_chunks is None else self.gram.unionByName(text.gram(self.long_weights, ["transcript_id"], "chunk_no"))

    def related_candidates(self) -> DataFrame:
        found = segment.related_in_gram(self.groups, self.gram, self.config)
        if self.long_chunks is None:
            return found
        long = self.groups.join(self.long, "transcript_id", "left_semi")
        return found.unionByName(segment.related_candidates(long, self.long_weights, self.config))

    @cached_property
    def groups(self) -> DataFrame:
        return self.keep(segment.walk(self.kept_chunks, self.band, self.config, self.decisions, self.step), "groups")

    @cached_property
    def merged(self) -> DataFrame:
        return self.keep(segment.merge_small(self.kept_chunks, self.groups, self.config, self.step), "merged")

    @cached_property
    def assigned(self) -> DataFrame:
        return segment.split_oversized(self.kept_chunks, self.groups, self.merged, segment.adjacent_similarity(self.band), self.config)

    @cached_property
    def topic_units(self) -> DataFrame:
        ids = self.numbered.withColumn("chunk_id", F.expr("concat('C', lpad(cast(chunk_no as string), greatest(3, length(cast(chunk_no as string))), '0'))"))
        return self.keep(topics.topic_units(ids, self.assigned), "topic_units")

    @cached_property
    def records(self) -> DataFrame:
        labels = self.decisions if self.decisions is not None and "topic_label" in self.decisions.columns else None
        return self.keep(topics.records(self.topic_units, turns.number_units(self.kept_turns), self.lines, self.config, labels), "records")

    @cached_property
    def linked(self) -> DataFrame:
        """All topics, validated, with their recurrence links."""
        return self.keep(topics.link_recurrence(provenance.validate(self.records, self.lines), self.config), "linked")

    @cached_property
    def index(self) -> DataFrame:
        """Valid topics; their order is chronological by place."""
        return self.linked.filter("provenance_ok")

    @cached_property
    def postings(self) -> DataFrame:
        """The inverted index that searches read, in folders by a hash of the term."""
        return self.keep(search.postings(self.index), "postings", ["bucket"])
