"""BPE encoding and decoding as streams.

Encoding is a transducer with bounded lookahead. From the merge list follows how far to the left of its
end the tokens of a prefix can still change (``sufficient_lookahead``); tokens that end before that
are emitted at once, so a run of any length is encoded with constant memory, and the work is linear in it.
Decoding is a state machine from bytes to text that holds back only an unfinished character.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidy, without

#: Characters on which NFC changes nothing and the installed regex module, ``str.lower`` and the
#: tokenizer library agree; texts with others are normalised and split by the library.
ALIKE = r"[\x00-\u02ff\u2000-\u206f]"
_TABLE = 150_000  # words a task remembers
_IDS = 1 << 14  # that are decoded at once
_NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = itertools.count(256)
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], size=len) -> int:
    """Symbols left of the end of a prefix beyond which its tokens no longer change.

    Compare a text with a longer one. They differ right of a frontier, at first the end of the
    shorter. It moves left only when a merge ``(u, v)`` takes the last common token ``u`` together
    with a ``v`` that begins at the frontier, by the size of ``u``. Afterwards ``u`` begins there, so
    the ``v`` of the next such merge, of a higher rank, has ``u`` on its left edge. The bound is the
    heaviest chain of this kind, found in one pass in the order of ranks.
    """
    best: dict[str, int] = {}  # heaviest chain so far that ends with this token as u
    lefts: dict[str, list[str]] = {}
    most = 0
    for u, v in merges:
        edge, chain, todo = set(), 0, [v]
        while todo:
            token = todo.pop()
            if token not in edge:
                edge.add(token)
                chain = max(chain, best.get(token, 0))
                todo += lefts.get(token, ())
        weight = size(u) + chain
        best[u] = max(best.get(u, 0), weight)
        lefts.setdefault(u + v, []).append(u)
        most = max(most, weight)
    return most


class Merges:
    """A vocabulary with its merges, as numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"]:
            raise ValueError("not a plain BPE vocabulary")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        cut = len(self.suffix)
        symbols = (lambda t: len(t) - cut if t.endswith(self.suffix) else len(t)) if cut else len
        self.lookahead = sufficient_lookahead(pairs, symbols)
        self.shift = max(self.vocab.values()).bit_length()
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.width = {i: symbols(t) for t, i in self.vocab.items()}
        for r, (u, v) in enumerate(pairs):
            self.rank.setdefault(self.vocab[u] << self.shift | self.vocab[v], r)
            self.made.append(self.vocab[u + v])
        letters = byte_characters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.suffix] for c in letters]
        self.special = {a["content"]: a["id"] for a in self.spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self._bytes: dict[bool, pa.Array] = {}

    @functools.cached_property
    def raw(self) -> dict[int, bytes]:
        """The bytes of each token; an end of word is a space."""
        codes = {c: b for b, c in enumerate(byte_characters())}
        out = {}
        for i, name in self.names.items():
            if name in self.special:
                out[i] = name.encode()
            else:
                ends = bool(self.suffix) and name.endswith(self.suffix)
                body = name.removesuffix(self.suffix) if ends else name
                out[i] = bytes(codes[c] for c in body) + b" " * ends
        return out

    def bytes_of(self, as_text: bool) -> pa.Array:
        """What each token adds to a decoded text: its bytes, or a space and its name."""
        if as_text not in self._bytes:
            known = {i: b" " + n.encode() for i, n in self.names.items()} if not as_text else self.raw
            self._bytes[as_text] = pa.array([known.get(i) for i in range(max(self.names) + 1)], pa.binary())
        return self._bytes[as_text]

    def merged(self, ids: list[int]) -> list[int]:
        """Tokens of a run of symbols."""
        if len(ids) <= 64:
            return self._merged_short(ids)
        get, shift = self.rank.get, self.shift
        while len(ids) > 1:
            ranks = [get(a << shift | b, _NEVER) for a, b in itertools.pairwise(ids)]
            least = min(ranks)
            if least == _NEVER:
                break
            new, i, last, out = self.made[least], 0, len(ranks), []
            while i < last:
                if ranks[i] == least:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            if i == last:
                out.append(ids[i])
            ids = out
        return ids


    def _merged_short(self, ids: list[int]) -> list[int]:
        """The same for short runs: one merge at a time, the leftmost of the lowest rank."""
        get, shift, made = self.rank.get, self.shift, self.made
        ids = list(ids)
        ranks = [get(a << shift | b, _NEVER) for a, b in itertools.pairwise(ids)]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            i, new = ranks.index(least), made[least]
            ids[i] = new
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << shift | ids[i + 1], _NEVER)
            if i:
                ranks[i - 1] = get(ids[i - 1] << shift | new, _NEVER)
        return ids


class Transducer:
    """Encodes one pre-token that comes in pieces of bytes."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.held: list[int] = []  # symbols whose tokens may still change
        self.last: int | None = None  # the last byte, which has another symbol if the word ends there
        self.limit = 4 * merges.lookahead + 64

    def feed(self, data: bytes) -> Iterator[list[int]]:
        """Take bytes, give the tokens that are stable."""
        inner = self.merges.inner
        for start in range(0, len(data), self.limit):
            part = data[start : start + self.limit]
            if self.last is not None:
                self.held.append(inner[self.last])
            self.held += [inner[b] for b in part[:-1]]
            self.last = part[-1]
            if len(self.held) >= self.limit:
                yield self._stable()

    def _stable(self) -> list[int]:
        tokens, width = self.merges.merged(self.held), self.merges.width
        end, out = 0, []
        for t in tokens:
            if end + width[t] > len(self.held) - self.merges.lookahead:
                break
            end += width[t]
            out.append(t)
        self.held = self.held[end:]
        return out

    def close(self) -> list[int]:
        """The rest, at the end of the word."""
        if self.last is None:
            return []
        rest = self.merges.merged([*self.held, self.merges.final[self.last]])
        self.held, self.last = [], None
        return rest


class Encoder:
    """Encodes texts; equal words are transduced once for as long as the table remembers them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.library = Tokenizer.from_file(path)  # normaliser and pre-tokeniser of other scripts
        spec = self.merges.spec
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError("the vocabulary must lower-case texts and split them into words and bytes")
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.odd = regex.compile(ALIKE.replace("[", "[^", 1)).search
        names = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")" if names else r"((?!))")
        self.bytes = {c: b for b, c in enumerate(byte_characters())}
        self.table: dict[str, bytes] = {}  # ids of words
        self.size = 0

    def word(self, data: bytes) -> list[int]:
        if len(data) <= 64:  # shorter than the lookahead: nothing is stable before the end
            inner = self.merges.inner
            return self.merges.merged([*[inner[b] for b in data[:-1]], self.merges.final[data[-1]]])
        machine = Transducer(self.merges)
        return [*itertools.chain.from_iterable(machine.feed(data)), *machine.close()]

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, some at a time."""
        for part in self.special.split(text):
            if part in self.merges.special:
                yield np.array([self.merges.special[part]], dtype=np.int32)
            elif part and self.odd(part) is None:
                words = self.words.findall(part.lower())
                for i in range(0, len(words), 8192):
                    yield self._known(words[i : i + 8192])
            elif part:
                whole = self.library.normalizer.normalize_str(part)
                for mapped, _ in self.library.pre_tokenizer.pre_tokenize_str(whole):
                    yield np.array(self.word(bytes(map(self.bytes.__getitem__, mapped))), dtype=np.int32)

    def _known(self, words: list[str]) -> np.ndarray:
        table = self.table
        if len(table) > _TABLE or self.size > _TABLE * 64:
            table.clear()
            self.size = 0
        for w in set(words).difference(table):
            table[w] = np.array(self.word(w.encode()), dtype=np.int32).tobytes()
            self.size += len(table[w])
        return np.frombuffer(b"".join(map(table.__getitem__, words)), dtype=np.int32)


class StreamEncoder:
    """Encodes a text that comes in pieces; holds back what follows the last white space."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.held = encoder, ""

    def feed(self, piece: str) -> Iterator[np.ndarray]:
        self.held += piece
        at = max(self.held.rfind(c) for c in " \t\n\r")
        if at >= 0:
            ready, self.held = self.held[:at], self.held[at:]
            yield from self.encoder.encode(ready)

    def close(self) -> Iterator[np.ndarray]:
        ready, self.held = self.held, ""
        yield from self.encoder.encode(ready)


class Decoder:
    """Ids to text, in pieces: ids give bytes, and a state machine that holds back an unfinished character gives text.

    A vocabulary file without a decoder gives its tokens joined by spaces. ``as_text`` gives the text that the
    tokens stand for: an end of word becomes a space, and bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, merges: Merges, as_text: bool = False):
        self.table, self.skip = merges.bytes_of(as_text), 0 if as_text else 1  # no space before the first name
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        found = self.table.take(pa.array(ids, pa.int32()))
        if not len(found):
            return ""
        offsets = np.frombuffer(found.buffers()[1], dtype=np.int32)
        data = memoryview(found.buffers()[2])[offsets[found.offset] + self.skip : offsets[found.offset + len(found)]]
        self.skip = 0
        return self.state.decode(data)

    def close(self) -> str:
        return self.state.decode(b"", True)


def decoded(merges: Merges, ids: np.ndarray, ends: list[int], as_text: bool) -> pa.Array:
    """Texts of several id sequences that stand one after the other."""
    texts = []
    for a, b in itertools.pairwise([0, *ends]):
        decoder = Decoder(merges, as_text)
        parts = [decoder.feed(ids[i : min(i + _IDS, b)]) for i in range(a, b, _IDS)]
        texts.append("".join([*parts, decoder.close()]))
    return pa.array(texts, pa.string())


def encode_documents(
    docs: DataFrame, path: str, *, text: str = "text", as_text: bool = False, text_as: str | None = None
) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded``, the text decoded from them.

    ``decoded`` is what the vocabulary's own decoder gives, or with ``as_text`` the text that the tokens stand for;
    ``text_as`` names a column that has the latter besides. Null texts count as empty. Input columns named ``ids`` or ``decoded`` are replaced; rows that repeat
    are all encoded. ``path`` names the vocabulary on the executors.
    """
    more = [text_as] if text_as else []
    plain = without(docs, "ids", "decoded", *more)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), *(T.StructField(n, T.StringType()) for n in ["decoded", *more])]
    schema = T.StructType([*plain.schema, *added])
    place, names = plain.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            encoder = encoder or Encoder(path)
            for batch in _slices(whole, place):
                parts, ends, total = [], [], 0
                for value in batch.column(place):
                    for ids in encoder.encode(value.as_py() or ""):
                        parts.append(ids)
                        total += len(ids)
                    ends.append(total)
                flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat))
                texts = [decoded(encoder.merges, flat, ends, kind) for kind in (as_text, *[True] * len(more))]
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, *texts], names=names)

    return plain.mapInArrow(tidy(run), schema)


def _slices(batch: pa.RecordBatch, place: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text: the results are several times as large."""
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most or i == len(sizes) - 1:
            yield batch.slice(first, i + 1 - first)
            first, held = i + 1, 0
