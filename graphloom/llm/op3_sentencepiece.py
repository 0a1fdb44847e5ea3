"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; it is read here field by field, and the pipeline is rebuilt
from it: the normaliser with its character map, the metaspace marker, a unigram model with
its scores or a BPE model whose merges follow from the scores, and byte fallback. Batches
are encoded by the library's own threads. Where no piece has a marker behind another
character, merges cannot cross the start of a marker run, so text is split there first,
and each different segment of a batch is encoded once; a worker remembers a bounded number
of them. Ids are decoded through the bytes of their pieces, and by the library where these
are not UTF-8. Every segment is compared with the reference library's ids when it becomes
known, so all texts are covered; where text is not split, or the model normalises it, every
text is compared. Some whole texts of every batch are compared too, and their decoding with
the tokenizers library's; any difference fails the task. round_trip holds the decoding of
every text against the text.

Results for edge cases: a null text has null ids, null decoded and 0 tokens; an empty text
has no ids; a very long text is encoded whole; characters outside the vocabulary become byte pieces, or the unknown piece
where the model has none; a null doc_id stays null; repeated rows are each returned; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.staging import prepare, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
THREADS = 2  # of one worker
PARITY_EVERY = 400  # texts; every batch's first is compared too
BATCH = 256
RUN = 512  # segments of one text for the library
KNOWN_CHARS = 6_000_000  # of the segments that a worker remembers
# Field numbers and enumerations of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else None)
            if size is None:
                raise ValueError(f"wire type {kind} is not known")
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """What a model file states."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.charsmap, self.prefix, self.squeeze, self.escape = UNIGRAM, b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append((text, score, kind))
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        self.kind = v
                    elif n == 24 and v:
                        raise ValueError("models that mark white space behind a word are not supported")
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        if any(k == USER_DEFINED for _, _, k in self.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bytes = any(p[2] == BYTE for p in self.pieces)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, by the score of what they make."""
        ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        found = []
        for text, i in ids.items():
            for cut in range(1, len(text)):
                a, b = ids.get(text[:cut]), ids.get(text[cut:])
                if a is not None and b is not None:
                    found.append((-self.pieces[i][1], i, a, b, text[:cut], text[cut:]))
        return [(x[-2], x[-1]) for x in sorted(found)]

    def separable(self) -> bool:
        """Whether no piece has the marker behind another character."""
        crossing = re.compile(f"[^{MARK}]{MARK}")
        return not any(crossing.search(p) for p, _, k in self.pieces if k == NORMAL)

    def tokenizer(self, normalise: bool = True):
        """The library's tokenizer; without normalise, of text that has been normalised."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.bytes)
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            core = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.bytes, cache_capacity=50_000 if normalise else 0)  # segments come once
        t = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if self.prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if normalise:
            t.normalizer = normalizers.Sequence(steps)
        if self.kind == BPE and self.separable():
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        end = [decoders.Strip(" ", 1, 0)] if self.prefix else []
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
        return t

    def piece_bytes(self) -> list[bytes]:
        """What each id stands for in decoded text, before the first space is dropped."""
        return [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.pieces]


class Codec:
    """Tokenizer of a model file with the reference library beside it."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = Model(data)
        self.tokenizer = self.model.tokenizer()
        self.segmented = self.model.kind == BPE and self.model.separable() and self.model.prefix and self.model.escape
        self.plain = not self.model.charsmap and not self.model.squeeze
        self.of_segments = self.model.tokenizer(normalise=False) if self.segmented else None
        self.known: dict[str, bytes] = {}  # ids of segments, four bytes each
        self.known_chars = 0
        self.piece_bytes = self.model.piece_bytes()
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)

    def segments(self, text: str) -> list[str]:
        """Segments of the normalised text, each without the marker that it begins with."""
        if self.plain:
            text = MARK + text.replace(" ", MARK) if text else ""
        else:
            text = self.tokenizer.normalizer.normalize_str(text)
        if not text:
            return []
        if MARK * 2 not in text:
            return text.split(MARK)[1:]
        return [s[1:] for s in re.findall(f"{MARK}+[^{MARK}]*", text)]

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment; many are joined to one text, which the tokenizer splits at the same places."""
        runs = [segments[i : i + RUN] for i in range(0, len(segments), RUN)]
        out = []
        for own, e in zip(runs, self.of_segments.encode_batch([MARK + MARK.join(r) for r in runs], add_special_tokens=False), strict=True):
            cut = np.flatnonzero(np.diff(np.array(e.word_ids, np.int64))) + 1
            if len(cut) + 1 == len(own):
                edge, ids = [0, *(4 * cut).tolist(), 4 * len(e.ids)], np.array(e.ids, np.int32).tobytes()
                out += [ids[a:b] for a, b in zip(edge, edge[1:], strict=False)]
            else:  # segments of markers alone run together
                out += [np.array(x.ids, np.int32).tobytes() for x in self.of_segments.encode_batch([MARK + s for s in own], add_special_tokens=False)]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.segmented:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self.segments(t) for t in texts]
        if self.known_chars > KNOWN_CHARS:
            self.known, self.known_chars = {}, 0
        new = sorted(set().union(*parts).difference(self.known))
        ids = self.encode_segments(new)
        if self.checks_segments:
            self.check_segments(new, ids)
        self.known.update(zip(new, ids, strict=True))
        self.known_chars += sum(map(len, new)) + 8 * len(new)
        of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(of, p)), np.int32) for p in parts]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        of, out, odd = self.piece_bytes.__getitem__, [], []
        for i, x in enumerate(ids):
            try:
                text = b"".join(map(of, x.tolist())).decode()
            except UnicodeDecodeError:
                odd.append(i)
                text = ""
            out.append(text[1:] if self.model.prefix and text.startswith(" ") else text)
        for i, text in zip(odd, self.tokenizer.decode_batch([ids[i].tolist() for i in odd], skip_special_tokens=False), strict=True):
            out[i] = text
        return out

    def check(self, text: str, ids: np.ndarray, decoded: str) -> None:
        if decoded != self.tokenizer.decode(ids.tolist(), skip_special_tokens=False):
            raise ValueError("text differs from the library's decoding")
        want, ids = self.reference.encode(text), ids.tolist()
        if want != ids:
            at = next((i for i, (a, b) in enumerate(zip(want, ids, strict=False)) if a != b), min(len(want), len(ids)))
            raise ValueError(f"ids differ from the reference library's at {at} of {len(want)}")

    @property
    def checks_segments(self) -> bool:
        """Whether every segment is compared as it becomes known; otherwise whole texts have to be."""
        return self.segmented and self.plain

    def check_segments(self, segments: list[str], ids: list[bytes]) -> None:
        """Ids of segments against the reference library's; it puts the first marker before each but an empty one."""
        mark = np.array([self.reference.piece_to_id(MARK)], np.int32).tobytes()
        for at in range(0, len(segments), RUN):
            own = segments[at : at + RUN]
            for s, got, want in zip(own, ids[at : at + RUN], self.reference.encode(own, num_threads=THREADS), strict=True):
                if got != (np.array(want, np.int32).tobytes() if s else mark):
                    raise ValueError(f"ids of the segment {s[:100]!r} differ from the reference library's")

    def normalised(self, text: str) -> str:
        """What decoding gives back: the text itself where the model does not normalise."""
        return text if not self.model.charsmap and not self.model.squeeze else self.reference.decode(self.reference.encode(text))


_codecs: dict[bytes, Codec] = {}


def codec(data: bytes, threads: int = THREADS) -> Codec:
    """The codec of a model, made once a worker."""
    key = hashlib.sha256(data).digest()
    if key not in _codecs:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        _codecs[key] = Codec(data)
    return _codecs[key]


def encoding(shared, parity_every: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(shared.value)
        seen = 0
        for part in parts:
            for at in range(0, len(part), BATCH):
                rows = part.iloc[at : at + BATCH]
                texts = [t or "" for t in rows["text"]]
                ids = own.encode(texts)
                back = own.decode(ids)
                for i, t in enumerate(texts):
                    if i == 0 or (seen + i) % parity_every == 0 or not own.checks_segments:
                        own.check(t, ids[i], back[i])
                seen += len(texts)
                null = rows["text"].isna().to_numpy()
                yield pd.DataFrame(
                    {
                        "doc_id": rows["doc_id"].astype("Int64").to_numpy(),
                        "n_tokens": [len(x) for x in ids],
                        "ids": [None if n else x for n, x in zip(null, ids, strict=True)],
                        "round_trip": [None if n else b == (t if b == t else own.normalised(t)) for n, b, t in zip(null, back, texts, strict=True)],
                    }
                )

    return run


OUT = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"


def encode_documents(docs: DataFrame, model: str = MODEL, parity_every: int = PARITY_EVERY) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every row of docs (doc_id, text).

    round_trip: the ids decode to the text as the model normalises it.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())  # the model file
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return given.mapInPandas(tidy(encoding(shared, parity_every)), OUT)


def decode_ids(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows (with a column ids) with decoded; null ids give null, an empty list an empty text. Other columns pass through."""
    shared = rows.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(shared.value)
        for part in parts:
            got = own.decode([np.array([] if x is None else x, np.int64) for x in part])
            yield pd.Series([None if x is None else g for x, g in zip(part, got, strict=True)], dtype=object)

    return rows.withColumn("decoded", decode("ids"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
