"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is parsed and rebuilt: normaliser, ``▁`` for spaces, BPE merges or unigram scores, byte fallback. If
no piece of the vocabulary continues past a ``▁``, a text falls apart into words there without changing its pieces, so a
worker encodes each distinct word once, many in one text. Every such word is encoded by the sentencepiece library
as well, and the two must agree (``parity``).
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, compress
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from . import words as W
from .tables import held, unwrapped, wrapped

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that a worker remembers at most; then it keeps those that came again.
REMEMBERED = 200_000
CHUNK_BYTES = 1 << 20
#: Words that are encoded as one text.
TOGETHER = 64
SPACE = "▁"
UNIGRAM, BPE = 1, 2  # fixed values: trainer_spec.model_type
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6  # fixed values: piece.type
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_ENCODED = "ids array<int>, n_tokens bigint, n_byte_tokens bigint, parity boolean"


def _merges(pieces: list) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, the best-scored piece first."""
    known = {p.piece: i for i, p in enumerate(pieces)}
    made = []
    for p in pieces:
        if p.type == NORMAL:
            cuts = [(p.piece[:k], p.piece[k:]) for k in range(1, len(p.piece))]
            made += [(-p.score, known[a], known[b], (a, b)) for a, b in cuts if a in known and b in known]
    return [pair for *_, pair in sorted(made)]


def rebuilt(model: bytes) -> Tokenizer:
    """The tokenizer that a SentencePiece model describes."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    kind, rules, pieces = proto.trainer_spec, proto.normalizer_spec, list(proto.pieces)
    if kind.model_type not in (UNIGRAM, BPE) or kind.treat_whitespace_as_suffix or any(p.type == USER_DEFINED for p in pieces):
        raise ValueError("only unigram and BPE models without user-defined pieces, with space as a prefix, are read")
    unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
    if kind.model_type == UNIGRAM:
        made = Tokenizer(models.Unigram([(p.piece, p.score) for p in pieces], unk_id=unknown, byte_fallback=kind.byte_fallback))
    else:
        made = Tokenizer(models.BPE({p.piece: i for i, p in enumerate(pieces)}, _merges(pieces), unk_token=pieces[unknown].piece,
                                    fuse_unk=True, byte_fallback=kind.byte_fallback))
    steps = [normalizers.Precompiled(rules.precompiled_charsmap)] if rules.precompiled_charsmap else []
    if rules.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(SPACE)] if rules.add_dummy_prefix else []
    made.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    made.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if rules.add_dummy_prefix else [])])
    return made


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class _Codec:
    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        names, kinds = [p.piece for p in proto.pieces], [p.type for p in proto.pieces]
        self.model = model
        self.plain_rules = not proto.normalizer_spec.precompiled_charsmap and not proto.normalizer_spec.remove_extra_whitespaces
        self.prefix = SPACE if proto.normalizer_spec.add_dummy_prefix else ""
        self.falls_apart = not any(re.search(f"[^{SPACE}]{SPACE}", name) for name in names)
        self.words = rebuilt(model)
        self.words.normalizer = normalizers.Sequence([])
        self.other = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([kind == BYTE for kind in kinds])
        self.data = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.lone = [self.other.piece_to_id(SPACE)]
        self.begins = np.array([name.startswith(SPACE) for name in names])
        # words in a row, each after one marker, are encoded as each alone: scores of a unigram model would be added in another order
        self.joins = self.falls_apart and proto.trainer_spec.model_type == BPE and kinds[self.lone[0]] == NORMAL
        self.known: dict[str, int] = {}
        self.sizes, self.hits, self.agrees, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32)

    @cached_property
    def whole(self) -> Tokenizer:
        """For models that texts don't fall apart in; others need no second tokenizer in each worker."""
        return rebuilt(self.model)

    def _forget(self) -> None:
        """Keep the words that came again, nothing else."""
        often = np.flatnonzero(self.hits > 1)
        starts = np.cumsum(self.sizes) - self.sizes
        self.ids = self.ids[_spans(starts[often], self.sizes[often])]
        self.sizes, self.agrees = self.sizes[often], self.agrees[often]
        kept = np.full(len(self.hits), -1)
        kept[often] = np.arange(len(often))
        self.known = {word: at for word, place in self.known.items() if (at := int(kept[place])) >= 0}
        self.hits = self.hits[often] // 4

    def _look_up(self, words: list[str]) -> np.ndarray:
        """The place of each word in ``sizes`` and ``agrees``; ``ids`` has their ids in order."""
        if len(self.known) > REMEMBERED:
            self._forget()
        places = list(map(self.known.get, words))
        missing = [i for i, place in enumerate(places) if place is None]
        if missing:
            new = list(dict.fromkeys([words[i] for i in missing]))
            joins = [self.joins and len(word) > 1 and word.rfind(SPACE) == 0 for word in new]
            new = [*compress(new, joins), *compress(new, map(operator.not_, joins))]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            sizes, ids = self._ids(new[:sum(joins)], new[sum(joins):])
            self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))
            self.agrees = np.concatenate((self.agrees, self._parity(new, sizes, ids)))
            self.hits = np.concatenate((self.hits, np.zeros(len(new), np.int64)))
            for i in missing:
                places[i] = self.known[words[i]]
        found = np.array(places, np.int64)
        self.hits += np.bincount(found, minlength=len(self.hits))
        return found

    def _ids(self, joined: list[str], single: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids in order. ``joined`` begin with the only marker in them and are encoded together."""
        runs = ["".join(joined[i:i + TOGETHER]) for i in range(0, len(joined), TOGETHER)]
        ids = [x.ids for x in self.words.encode_batch_fast(runs + single, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        n = sum(map(len, ids[:len(runs)]))
        sizes = np.diff(np.append(np.flatnonzero(self.begins[flat[:n]]), n))
        return np.concatenate((sizes, np.array([len(x) for x in ids[len(runs):]], np.int64))), flat

    def _parity(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Does the sentencepiece library give the same ids?"""
        # it puts the marker before a text itself, so it gets a word without its first one
        expected = self.other.encode([word[1:] if word[0] == SPACE else word for word in words], num_threads=1)
        # a marker without a word is nothing but its piece
        expected = [a or self.lone for a in expected]
        theirs = np.array([len(a) for a in expected], np.int64)
        flat, same = np.fromiter(chain.from_iterable(expected), np.int32), sizes == theirs
        unequal = ids[_spans((np.cumsum(sizes) - sizes)[same], sizes[same])] != flat[_spans((np.cumsum(theirs) - theirs)[same], sizes[same])]
        same[np.flatnonzero(same)[np.repeat(np.arange(same.sum()), sizes[same])[unequal]]] = False
        return same

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, where each text's begin (one more at the end), and parity of each text."""
        if not (self.falls_apart and self.plain_rules and self.prefix):
            ids = [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            same = np.array([a == b for a, b in zip(self.other.encode(texts, num_threads=1), ids, strict=True)], bool)
            return np.fromiter(chain.from_iterable(ids), np.int32), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64), same
        split = [_WORD.findall(self.prefix + text.replace(" ", SPACE)) if text else [] for text in texts]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in split]))).astype(np.int64)
        places = self._look_up(list(chain.from_iterable(split)))
        sizes = self.sizes[places]
        at = _spans((np.cumsum(self.sizes) - self.sizes)[places], sizes)
        wrong = np.concatenate(([0], np.cumsum(~self.agrees[places])))
        return self.ids[at], np.concatenate(([0], np.cumsum(sizes)))[ends], np.diff(wrong[ends]) == 0

    def decode(self, ids: list[np.ndarray | list[int]]) -> list[str]:
        """Pieces joined, ``▁`` as space, byte pieces as bytes; the marker before the text is taken off."""
        out = []
        for own in ids:
            text = b"".join(map(self.data.__getitem__, own)).decode(errors="replace")
            out.append(text[1:] if self.prefix and text[:1] == " " else text)
        return out


def _codec(model: bytes) -> _Codec:
    return held(_Codec, model)


def _texts(codec: _Codec, ids: pa.ListArray) -> pa.Array:
    flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    texts = codec.decode([flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return pa.array([None if null else x for null, x in zip(ids.is_null().to_pylist(), texts, strict=True)], pa.string())


def encoded(docs: DataFrame, text: str = "text", model: str = MODEL, decode: bool = False) -> DataFrame:
    """Rows of ``docs`` with ``ids``, ``n_tokens``, ``n_byte_tokens``, ``parity`` and, with ``decode``, ``decoded``: the text of the ids.

    ``model`` is a file on the driver; its bytes go to the workers. Null texts give null ids, no tokens and parity; empty texts give
    empty ids. Input columns stay; a result replaces one of its name. Nothing is shuffled. Empty in, empty out.
    """
    file = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    rows = wrapped(docs, text=F.col(text))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(_ENCODED + (", decoded string" if decode else "")).fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file.value)
        for batch in batches:
            for at, texts in W.chunks(batch.column("text"), CHUNK_BYTES):
                ids, ends, same = codec.encode([x.decode(errors="replace") for x in texts])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=batch.column("text").slice(at, len(texts)).is_null())
                in_bytes = np.concatenate(([0], np.cumsum(codec.is_byte[ids])))
                own = [batch.column("row").slice(at, len(texts)), lists, pa.array(np.diff(ends)), pa.array(np.diff(in_bytes[ends]).astype(np.int64)), pa.array(same)]
                if decode:
                    own.append(_texts(codec, lists))
                yield pa.RecordBatch.from_arrays(own, [f.name for f in schema.fields])

    out = rows.mapInArrow(encode, schema)
    return unwrapped(out, {f.name: F.col(f.name) for f in schema.fields[1:]})


def decoded(rows: DataFrame, ids: str = "ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """Rows with the text of ``ids`` in ``into``; null ids give null. The text is the normalised one where the model normalises."""
    file = rows.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    held = wrapped(rows, ids=F.col(ids))
    schema = T.StructType([held.schema["row"], T.StructField(into, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), _texts(codec, batch.column("ids"))], ["row", into])

    return unwrapped(held.mapInArrow(decode, schema), {into: F.col(into)})
