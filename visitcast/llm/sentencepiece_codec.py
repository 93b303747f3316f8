"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model protobuf is parsed, and its normaliser, the metaspace marker, the pieces
with their scores, and byte fallback are rebuilt as a tokenizers object: Unigram
for a unigram model; for a BPE model the scores give the rank of each merge, since
Unigram segmentation over BPE scores would give other ids. Parity with the
sentencepiece library is verified while encoding: each distinct unit of a batch is
encoded by both, and where they differ the library's ids win and are counted.

A unit is a run of markers and what follows up to the next marker. If no piece has
a marker after another character (checked when the model is read; true of models
trained with whitespace splitting), no merge crosses units, so ids of units joined
are ids of the text, and repeated words are encoded once. Other models are encoded
text by text, by both libraries too. Batches of units are encoded on several threads.
What a worker remembers is bounded in bytes.

The model's bytes (a bounded file) travel with the tasks; no task opens its path.

Defined results: a null text has null ids and 0 tokens; an empty text has no ids;
every other string decodes to what the normaliser made of it. Repeated rows are
encoded each; extra columns pass through encode().
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from visitcast.llm.common import modest_batches, spread, table
from visitcast.llm.text_bytes import tidied

MARKER = "▁"
#: Bytes of units and ids that each of two generations in a worker remembers, besides the units of one batch, and rows whose ids are built at once.
REMEMBERED, ROWS = 12 << 20, 256
#: What a remembered unit takes besides its characters and ids, about.
BESIDE = 160
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
THREADS = 2


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Codec:
    """A SentencePiece model rebuilt on the tokenizers library."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer, decoders, models, normalizers

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        trainer, norm = proto.trainer_spec, proto.normalizer_spec
        if trainer.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("models that mark the ends of words, or no words, aren't supported")
        self.unknown = trainer.unk_id
        self.fallback = trainer.byte_fallback
        if trainer.model_type == 1:
            built = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.fallback)
        elif trainer.model_type == 2:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            usable = {p for p, _, t in self.pieces if t in (NORMAL, USER)}
            merges = []
            for p, score, t in self.pieces:
                if t == NORMAL and len(p) > 1:
                    merges += [(-score, vocab[p], i, p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
            built = models.BPE(vocab, [(a, b) for *_, a, b in sorted(merges)], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.fallback)
        else:
            raise ValueError("only unigram and BPE models are supported")
        steps = []
        if norm.precompiled_charsmap:
            steps.append(normalizers.Precompiled(norm.precompiled_charsmap))
        if norm.remove_extra_whitespaces:
            from tokenizers import Regex

            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
        self.cleaner = normalizers.Sequence(steps) if steps else None
        self.dummy = norm.add_dummy_prefix
        self.tokenizer = Tokenizer(built)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.splits = not any(re.search(f"[^{MARKER}]{MARKER}", p) for p, _, _ in self.pieces) and self.dummy
        self.unit = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = self.differing = 0
        text = lambda p, t: bytes([int(p[3:-1], 16)]) if t == BYTE else (b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARKER, " ").encode())
        self.spelled = [text(p, t) for p, _, t in self.pieces]

    def normalised(self, text: str) -> str:
        """What decoding gives back: the text after the model's normaliser."""
        return self.cleaner.normalize_str(text) if self.cleaner else text

    def marked(self, text: str) -> str:
        text = self.normalised(text).replace(" ", MARKER)
        return MARKER + text if self.dummy and text else text

    def learn(self, units: list[str]) -> None:
        """Encodes units by the tokenizers library and by sentencepiece and remembers the ids."""
        ours = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        # The dummy prefix that sentencepiece adds is the unit's first marker.
        theirs = self.reference.encode([u[1:].replace(MARKER, " ") for u in units], num_threads=THREADS)
        for u, a, b in zip(units, ours, theirs, strict=True):
            ids = a.ids
            # A lone marker can't be told from an empty text there.
            if u != MARKER and ids != b:
                self.differing += 1
                ids = b
            self.remember(u, array("i", ids).tobytes())

    def remember(self, unit: str, ids: bytes) -> None:
        self.known[unit] = ids
        self.held += 2 * len(unit) + len(ids) + BESIDE

    def forget(self) -> None:
        self.known, self.older, self.held = {}, {}, 0

    def recall(self, units: set[str]) -> None:
        """Makes every unit known; what wasn't met since the last change of generation is forgotten."""
        if self.held > REMEMBERED:
            self.known, self.older, self.held = {}, self.known if self.held <= 2 * REMEMBERED else {}, 0
        fresh = []
        for u in units:
            if u not in self.known:
                if u in self.older:
                    self.remember(u, self.older[u])
                else:
                    fresh.append(u)
        if fresh:
            self.learn(fresh)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.splits:
            ours = self.tokenizer.encode_batch_fast([self.marked(t) for t in texts], add_special_tokens=False)
            theirs = self.reference.encode(texts, num_threads=THREADS)
            self.differing += sum(a.ids != b for a, b in zip(ours, theirs, strict=True))
            return [np.asarray(x, dtype=np.int32) for x in theirs]
        parts = [self.unit.findall(self.marked(t)) for t in texts]
        self.recall(set().union(*parts))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), dtype=np.int32) for p in parts]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of id lists, pieces spelled and bytes joined; the dummy prefix goes."""
        out = []
        for x in ids:
            text = b"".join(map(self.spelled.__getitem__, x.tolist())).decode("utf-8", "replace")
            out.append(text[1:] if self.dummy and text.startswith(" ") else text)
        return out

    def decode_by_library(self, ids: list[np.ndarray]) -> list[str]:
        """The same by the decoder of the tokenizers library (for id lists without control pieces)."""
        texts = self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
        return [t[1:] if self.dummy and t.startswith(" ") else t for t in texts]


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """The codec of a model; a worker process builds it once."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes, kept: list[str]) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    try:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column("text").to_pylist()
                before = c.differing
                ids = c.encode([t or "" for t in texts])
                back = c.decode(ids)
                same = [t is None or c.normalised(t) == b for t, b in zip(texts, back, strict=True)]
                counts = np.array([len(x) for x in ids], dtype=np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                listed = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
                extra = [pa.array(counts), listed, pa.array(same, pa.bool_()), pa.array(np.full(batch.num_rows, c.differing - before, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *extra], [*kept, "_n_tokens", "_token_ids", "_round_trip", "_differing"])
    finally:
        c.forget()


def encode(docs: DataFrame, model: bytes | None = None, keep_text: bool = True) -> DataFrame:
    """docs with _n_tokens, _token_ids, _round_trip (decoding gives the text back) and _differing.

    _differing is the number of units, first met in the row's batch, on which the
    rebuilt model and the sentencepiece library disagreed. Without keep_text the text
    doesn't come back from the Python workers.
    """
    data = model if model is not None else Path(default_model()).read_bytes()
    added = (("_n_tokens", T.LongType()), ("_token_ids", T.ArrayType(T.IntegerType())), ("_round_trip", T.BooleanType()), ("_differing", T.LongType()))
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    kept = [f.name for f in fields]
    modest_batches(docs.sparkSession)
    return docs.mapInArrow(lambda it: tidied(_encoded(it, data, kept)), T.StructType([*fields, *(T.StructField(*x) for x in added)]))


def _decoded(batches: Iterator[pa.RecordBatch], model: bytes, column: str) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for batch in batches:
        ids = batch.column(column).to_pylist()
        texts = iter(c.decode([np.asarray(x, dtype=np.int32) for x in ids if x is not None]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else next(texts) for x in ids], pa.string())], [*batch.schema.names, "_decoded"])


def decode(rows: DataFrame, column: str = "token_ids", model: bytes | None = None) -> DataFrame:
    """rows with _decoded: the text of the ids in `column`; null for null."""
    data = model if model is not None else Path(default_model()).read_bytes()
    modest_batches(rows.sparkSession)
    return rows.mapInArrow(lambda it: _decoded(it, data, column), T.StructType([*rows.schema.fields, T.StructField("_decoded", T.StringType())]))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text, whether decoding gives the text back, and in how many units of its batch the libraries differed (0: parity)."""
    found = encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), keep_text=False)
    return found.selectExpr("doc_id", "_n_tokens AS n_tokens", "_token_ids AS token_ids", "_round_trip AS round_trip", "_differing AS n_differing")
