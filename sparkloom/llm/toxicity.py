"""Compression-distance classification of toxic text with two zstandard dictionaries.

A window of text is compressed once with a dictionary of ordinary text and once with one of toxic text; the bytes that
the toxic dictionary saves are the window's gain. A document's score is the sum of its windows' gains that reach the
window threshold, over the root of the number of windows. Both thresholds are calibrated on labelled documents that
the dictionaries have not seen.

Both dictionaries are trained by zstandard's cover algorithm, each on its own class. Trained on whole texts they are
mostly the same ordinary phrases, chosen differently, and that difference drowns the few toxic words. So each class is
trained on what the other lacks: first on the words that no text of the other class has, then, in further rounds, on the
windows that the dictionaries before told apart. A third dictionary, trained on ordinary text, follows either one, so that
common text costs the same with both. The round that separates the calibration documents best is kept.

A window is a word between two fixed carriers: the one before makes every window large enough to be compressed at all,
the one after lets matches reach the window's end (the match finder stops 16 bytes short of it).
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import doc_hash, per_batch, written

HEAD = b"The quick onyx goblin jumps over 13 lazy dwarves, vexing #"
TAIL = bytes(range(1, 25))
#: Longer words are cut into windows of so many bytes, each half over the one before.
WINDOW_BYTES = 64
#: The most rows of each class that are read for training and calibration, and the longest texts among them.
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_CHARS = 3000, 6000, 20_000
#: A class of fewer rows can't be trained on.
LEAST = 12
#: Bytes of a class's own dictionary and of the shared one, the cover algorithm's segments and d-mers.
OWN_BYTES, SHARED_BYTES = 8_000, 64_000
OWN_SEGMENT, SHARED_SEGMENT, DMER = 10, 32, 6
ROUNDS = 3
CACHE = 400_000


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    window_gain: int
    threshold: float


def windows(text: str) -> list[str]:
    """The words of a text in lower case; a word of over WINDOW_BYTES characters in overlapping pieces."""
    words = text.lower().split()
    if any(len(w) > WINDOW_BYTES for w in words):
        step = WINDOW_BYTES // 2
        words = [p for w in words for p in ([w] if len(w) <= WINDOW_BYTES else [w[i : i + WINDOW_BYTES] for i in range(0, len(w) - step, step)])]
    return words


class Gains:
    """Bytes saved by the toxic dictionary, by window, remembered."""

    def __init__(self, toxic: bytes, ordinary: bytes, least: int):
        import zstandard as z

        self.z, self.least, self.known, self.compressors = z, least, {}, []
        p = z.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=4, target_length=32, strategy=z.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
        for content in (toxic, ordinary):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.compressors.append(z.ZstdCompressor(dict_data=d, compression_params=p))

    def of(self, words: Iterable[str]) -> dict[str, int]:
        """The gain of every word (not over WINDOW_BYTES long), 0 if below the least."""
        out = {}
        words = list(words)
        for i in range(0, len(words), 100_000):
            part = {w for w in words[i : i + 100_000] if len(w) <= WINDOW_BYTES}
            self.learn(part)
            out.update((w, self.known.get(w, 0)) for w in words[i : i + 100_000])
        return out

    def learn(self, words: set[str]) -> None:
        import numpy as np

        if len(self.known) > CACHE:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for i in range(0, len(new), 100_000):
            part = new[i : i + 100_000]
            pieces = [HEAD + b" " + w.encode("utf-8", "replace") + b" " + TAIL for w in part]
            length = np.array([len(x) for x in pieces], dtype=np.uint64)
            at = np.zeros(len(pieces), dtype=np.uint64)
            np.cumsum(length[:-1], out=at[1:])
            buffer = self.z.BufferWithSegments(b"".join(pieces), np.stack([at, length], 1).tobytes())
            sizes = []
            for c in self.compressors:
                out = c.multi_compress_to_buffer(buffer, threads=1)
                sizes.append([len(out[k]) for k in range(len(out))])
            self.known.update((w, o - t if o - t >= self.least else 0) for w, t, o in zip(part, *sizes))

    def _each(self, texts: list[str | None]) -> Iterator[tuple[Iterator[int], int]]:
        """The gains of every text's windows, and how many windows it has."""
        for i in range(0, len(texts), 500):
            each = [windows(t) if t else [] for t in texts[i : i + 500]]
            self.learn({w for ws in each for w in ws})
            get = self.known.__getitem__
            yield from ((map(get, ws), len(ws)) for ws in each)

    def found(self, texts: list[str | None]) -> list[tuple[list[int], int]]:
        """The gains above 0 of every text, and how many windows it has."""
        return [(list(filter(None, gains)), n) for gains, n in self._each(texts)]

    def scores(self, texts: list[str | None]) -> list[float]:
        """A null text, like one without words, scores 0."""
        return [sum(gains) / n**0.5 if n else 0.0 for gains, n in self._each(texts)]


#: Repeat offsets with which the header of a trained dictionary ends.
_HEADER_END = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))


def trained(samples: list[str], size: int, segment: int) -> bytes:
    """The content, without the header, of a dictionary that zstandard trains; of too few samples, the samples themselves."""
    import zstandard as z

    data = [x.encode("utf-8", "replace") for x in samples]
    try:
        out = z.train_dictionary(size, data, k=segment, d=DMER).as_bytes()
    except z.ZstdError:
        return b"".join(data)[:size]
    return out[out.index(_HEADER_END, 8) + len(_HEADER_END) :]


def _samples(texts: list[str], wanted) -> list[str]:
    """Of every text the words that are wanted, each once, as one sample; texts without any give none."""
    each = ([w for w in dict.fromkeys(t.split()) if wanted(w)] for t in texts)
    return [" " + " ".join(ws) + " " for ws in each if ws]


def rounds(toxic: list[str], ordinary: list[str]) -> Iterator[tuple[bytes, bytes]]:
    """The dictionaries (toxic, ordinary) of every round, from texts of the two classes in lower case."""
    shared = trained([" ".join(w[i : i + 8]) for t in ordinary for w in [t.split()] for i in range(0, len(w), 8)], SHARED_BYTES, SHARED_SEGMENT) + HEAD
    own = []
    for texts, others in ((toxic, ordinary), (ordinary, toxic)):
        known = {w for t in others for w in re.findall(r"\w+", t)}
        own.append(trained(_samples([" ".join(re.findall(r"\w+", t)) for t in texts], lambda w: w not in known), OWN_BYTES, OWN_SEGMENT))
    for _ in range(ROUNDS - 1):
        yield own[0] + shared, own[1] + shared
        g = Gains(own[0] + shared, own[1] + shared, 2)
        for k, texts in enumerate((toxic, ordinary)):
            told = {w for t in texts for w in t.split()}
            gain = g.of(told)
            samples = _samples(texts, lambda w: gain[w] > 0)
            # Too little to train on: the class has no such windows left, and keeps its dictionary.
            if sum(map(len, samples)) > OWN_BYTES // 2:
                own[k] = trained(samples, OWN_BYTES, OWN_SEGMENT)
    yield own[0] + shared, own[1] + shared


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """Dictionaries from two thirds of each class, the round and thresholds from the rest. None, with a warning, if a class has under LEAST texts."""
    if min(len(toxic), len(ordinary)) < LEAST:
        warnings.warn(f"{len(toxic)} toxic and {len(ordinary)} ordinary labelled texts are too few: there is no model, and nothing will be toxic", stacklevel=2)
        return None
    learn = [[t.lower() for i, t in enumerate(x) if i % 3] for x in (toxic, ordinary)]
    held = [[t for i, t in enumerate(x) if i % 3 == 0] for x in (toxic, ordinary)]
    best: tuple[float, Model] | None = None
    for d in rounds(*learn):
        # Compressed once; each threshold only leaves out the lesser gains.
        g = Gains(*d, 1)
        found = [g.found(x) for x in held]
        for gain in (1, 2, 3, 4):
            yes, no = (sorted(sum(x for x in gains if x >= gain) / n**0.5 if n else 0.0 for gains, n in part) for part in found)
            for cut in sorted({x for x in yes if x > 0}):
                caught, wrong = sum(x >= cut for x in yes) / len(yes), sum(x >= cut for x in no) / len(no)
                value = caught - 20 * wrong
                if best is None or value > best[0] + 1e-9:
                    # A little below it, towards the next clean document.
                    below = max((x for x in no if x < cut), default=0.0)
                    best = value, Model(*d, gain, cut - (cut - below) / 10)
    return best[1] if best else None


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_toxic: int = TRAIN_TOXIC,
    max_ordinary: int = TRAIN_ORDINARY,
    max_chars: int = TRAIN_CHARS,
) -> Model | None:
    """A model from labelled documents: of each class at most ``max_toxic`` or ``max_ordinary`` rows, by the hash of the id.

    Null ids, texts and labels, and texts of more than ``max_chars`` characters, are passed over (all are scored, whole).
    Rows of one id are texts each; an id of two labels is toxic. Ties of the hash go by id, then text. None, with a
    warning, if a class has under LEAST rows, as in empty tables. Other columns, whatever their names, are ignored.
    """
    sample = None
    most = {1: max_toxic, 0: max_ordinary}
    for label, n in most.items():
        part = labels.filter((F.col(label_col) == label) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.lit(label).alias("_label")).orderBy(doc_hash(F.col("_id"), "toxicity"), "_id").limit(n)
        sample = part if sample is None else sample.unionByName(part)
    # The sample is bounded, so it may always be broadcast.
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).filter(F.length("_text") <= max_chars)
    rows = written(texts.join(F.broadcast(sample.groupBy("_id").agg(F.max("_label").alias("_label"))), F.col("_doc") == F.col("_id")).select("_id", "_label", "_text"))
    # An id may have any number of rows, so they are bounded too.
    held = [[r["_text"] for r in rows.filter(F.col("_label") == label).orderBy(doc_hash(F.col("_id"), "toxicity"), "_id", "_text").limit(n).select("_text").collect()] for label, n in most.items()]
    return fit(*held)


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxicity, is_toxic) of every row; without a model all score 0 and none is toxic.

    Null and empty texts score 0. Texts are read whole, however long. Equal texts, and so repeated rows, score alike; a
    score at the threshold is toxic. An empty table gives an empty one. Other columns are ignored; a column of ours that
    is named like the id has underscores before it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ours = {"toxicity": "double", "is_toxic": "boolean"}
    if model is None:
        toxicity, is_toxic = (common.fresh([id_col], n) for n in ours)
        return docs.select(F.col(id_col), F.lit(0.0).alias(toxicity), F.lit(False).alias(is_toxic))

    def make():
        g = Gains(model.toxic, model.ordinary, model.window_gain)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            s = g.scores(b.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([x >= model.threshold for x in s], pa.bool_())], names=["id", "toxicity", "is_toxic"])

        return run

    return per_batch(docs, [id_col, text_col], make, common.schema_of(id_col, kind, ours))


def drop_toxic(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """The rows that are not toxic, with all their columns, whatever their names. Without a model all stay.

    Rows of null or empty text stay; repeated rows, and all rows of one text, fare alike; a score at the threshold is
    toxic. Texts are read whole, however long. An empty table gives an empty one.
    """
    if model is None:
        return docs

    def run(batches):
        g = Gains(model.toxic, model.ordinary, model.window_gain)
        for b in batches:
            keep = [x < model.threshold for x in g.scores(b.column(at).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    """The documents that are toxic, with their scores."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).filter("is_toxic").select("doc_id", "toxicity")
