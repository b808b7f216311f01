"""The whole way from reads to join candidates, run in the background with a status and a way to stop it.

reads -> distinct -> windows -> representatives -> embedding -> neighbours -> alignments -> sums by subgraph -> best targets ->
queue of joins -> alignments of their paths. Each phase is a DataFrame; between phases results are written to the shared
checkpoint folder, so that a lost executor costs one phase at most.
"""

from __future__ import annotations

import logging
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerframe.config import AssemblerConfig, AssemblyState, AssemblySubState, SequenceType
from kmerframe.functions import alphabets
from kmerframe.functions.alignment import with_scores
from kmerframe.operators import graphs, lists, reads, scoring, search
from kmerframe.operators.embedding import Embedder, OnnxEmbedder, SpectrumEmbedder
from kmerframe.runtime import cut
from kmerframe.sources.cache import embedded_once
from kmerframe.sources.fasta import read_fasta

_LOG = logging.getLogger("kmerframe")


@dataclass
class Status:
    """reads are unique ones, records all of them; a duration is -1 until its phase has begun."""

    state: AssemblyState = AssemblyState.UNINITIALISED
    sub_state: AssemblySubState = AssemblySubState.NONE
    records: int = 0
    reads: int = 0
    kmers: int = 0
    alignments: int = 0
    joins: int = 0
    seconds: dict[str, float] = field(default_factory=lambda: {s.name: -1.0 for s in AssemblySubState if s is not AssemblySubState.NONE})
    error: str | None = None


def neighbours_of(embeddings: DataFrame, k: int, exact: bool) -> DataFrame:
    """(a, b, dist, rank) of k-mers (id, embedding): the k nearest, without the k-mer itself, ties by id.

    exact compares all rows in blocks, whose work grows with the square of the rows; otherwise rows are compared with those of the
    nearest lists around centroids, which is approximate, with a number of copies and lists for each row that does not grow.
    """
    if exact:
        found = search.exact_neighbours(embeddings, embeddings, k)
    else:
        found = lists.list_neighbours(embeddings, k)
    return found.select(F.col("query").alias("a"), F.col("neighbour").alias("b"), (1 - F.col("cosine")).alias("dist"), "rank")


class Assembler:
    """start_async, status, wait, abort. One run at a time; the results are DataFrames in `results` once a phase is done.

    cache: a folder that keeps embeddings between runs, by model; k-mers that are kept there are not embedded again.
    """

    def __init__(self, spark: SparkSession, config: AssemblerConfig | None = None, embedder: Embedder | None = None, exact: bool = False, itself: bool = False, cache: str | None = None):
        self.spark, self.config, self.exact, self.itself = spark, config or AssemblerConfig(), exact, itself
        self.embedder, self.cache = embedder, cache
        self.results: dict[str, DataFrame] = {}
        self._status, self._thread, self._stop = Status(), None, threading.Event()
        self._tag = f"assembly-{uuid.uuid4().hex}"

    def _embedded(self, kmers: DataFrame) -> DataFrame:
        path = self.config.seqemb_onnx_path
        embedder = self.embedder or (OnnxEmbedder(path, alphabets.ORDERS[self._kind.value]) if path else SpectrumEmbedder())
        if self.cache is None:
            return embedder(kmers)
        return embedded_once(kmers, embedder, self.cache, f"{type(embedder).__name__}-{path or ''}-{self._kind.value}-{self.config.kmer_len}".replace("/", "_"))

    def start_async(self, path: str, kind: SequenceType = SequenceType.DNA) -> None:
        """Assemble a FASTA file, folder or pattern in the background."""
        self._begin(lambda: read_fasta(self.spark, path), kind)

    def start_reads(self, sequences: list[str], kind: SequenceType = SequenceType.DNA) -> None:
        """The same for texts in memory."""
        rows = [("memory", i, "", None, s) for i, s in enumerate(sequences, 1)]
        self._begin(lambda: self.spark.createDataFrame(rows, "path string, ordinal long, name string, description string, data string"), kind)

    def status(self) -> Status:
        return self._status

    def wait(self, seconds: float | None = None) -> Status:
        if self._thread:
            self._thread.join(seconds)
        return self._status

    def abort(self) -> None:
        """Stop the running jobs; the run ends in the state ABORTED."""
        self._stop.set()
        self.spark.interruptTag(self._tag)

    def _begin(self, source, kind: SequenceType) -> None:
        if kind is SequenceType.AMINO_ACID:
            raise ValueError("amino acids can be stored but not embedded")
        if self._thread and self._thread.is_alive():
            raise RuntimeError("an assembly is running")
        self._stop.clear()
        self._kind = kind if kind is SequenceType.RNA else SequenceType.DNA
        self._status = Status(state=AssemblyState.IN_PROGRESS)
        self._thread = threading.Thread(target=self._run, args=(source,), daemon=True)
        self._thread.start()

    def _run(self, source) -> None:
        self.spark.addTag(self._tag)
        try:
            self._phases(source())
            self._status.state = AssemblyState.COMPLETE
        except Exception as e:  # the thread always ends in a final state
            self._status.state = AssemblyState.ABORTED if self._stop.is_set() else AssemblyState.ERROR
            self._status.error = None if self._stop.is_set() else str(e)
            _LOG.info("assembly ended: %s", self._status.state)
        finally:
            self._status.sub_state = AssemblySubState.NONE

    def _phase(self, phase: AssemblySubState):
        if self._stop.is_set():
            raise InterruptedError
        now = time.monotonic()
        if self._status.sub_state is not AssemblySubState.NONE:
            self._status.seconds[self._status.sub_state.name] = now - self._since
        self._since, self._status.sub_state = now, phase
        self._status.seconds[phase.name] = 0.0

    def _phases(self, records: DataFrame) -> None:
        k, r, s = self.config.kmer_len, self.results, self._status
        self._phase(AssemblySubState.READS)
        s.records = records.count()
        found = reads.deduplicated(records)
        only_path = found.select("path").distinct().count() <= 1
        r["reads"] = cut(found.withColumnRenamed("ordinal", "seq_id") if only_path else reads.numbered(found, ["path", "ordinal"], "seq_id")).select("seq_id", "sequence", "instances")
        s.reads = r["reads"].count()
        self._phase(AssemblySubState.EMBEDDING)
        places = reads.windows(r["reads"], k)
        r["representatives"] = cut(reads.numbered(reads.representatives(places), ["seq_id", "off"], "id"))
        kmers = r["representatives"].select("id", "kmer", "seq_id", "off")
        s.kmers = kmers.count()
        r["embeddings"] = cut(kmers.select("id", "kmer").join(self._embedded(kmers.select("kmer")), "kmer").select("id", "embedding"))
        self._phase(AssemblySubState.CANDIDATES)
        r["candidates"] = cut(neighbours_of(r["embeddings"], self.config.knn_top_k - 1, self.exact))
        candidates = r["candidates"].select("a", "b")
        r["alignments"] = cut(scoring.alignments(candidates, kmers.select("id", "kmer")))
        s.alignments = r["alignments"].count()
        self._phase(AssemblySubState.SCORING)
        # one graph per read; the last window of a read is not scored
        lengths = r["reads"].select("seq_id", F.length("sequence").alias("len"))
        here = places.join(lengths, "seq_id").where(F.col("off") < F.col("len") - k).join(kmers.select("kmer", "id"), "kmer").select(F.col("seq_id").alias("graph_id"), "id")
        counted = cut(scoring.place_counts(here))
        home = kmers.select("id", F.col("seq_id").alias("graph_id"))
        r["sums"] = scoring.subgraph_sums(counted, candidates, r["alignments"], home)
        with_candidates = counted.join(candidates.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
        counts = r["reads"].select(F.col("seq_id").alias("graph_id")).join(with_candidates.groupBy("graph_id").agg(F.sum("n").alias("n")), "graph_id", "left").select("graph_id", F.coalesce("n", F.lit(0)).alias("n"))
        r["best"] = cut(scoring.best_targets(r["sums"], counts, self.itself))
        r["queue"] = scoring.join_queue(r["best"].where("target <> graph_id"), self.config.subgraph_join_threshold)
        self._phase(AssemblySubState.JOINING)
        s.joins = r["queue"].count()
        members = r["reads"].select(F.col("seq_id").alias("graph_id"), "seq_id")
        _, _, edges = graphs.read_graphs(r["reads"], members)
        paths = edges.select("graph_id", F.col("label").alias("text"))
        pairs = r["queue"].join(paths.toDF("gd_lo", "ta"), "gd_lo").join(paths.toDF("gd_hi", "tb"), "gd_hi").select("gd_lo", "gd_hi", "ta", "tb")
        r["path_scores"] = cut(with_scores(pairs, "ta", "tb").select("gd_lo", "gd_hi", "score"))
        s.seconds[AssemblySubState.JOINING.name] = time.monotonic() - self._since
