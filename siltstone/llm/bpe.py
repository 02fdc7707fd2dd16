"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A tokenizer file (word-end BPE over byte symbols) is read once per worker. Text runs through in pieces: added tokens
are cut out, the rest is normalised, cut into words, and each word's bytes are merged as they come: from the merge list
follows how many symbols behind a place can still change the tokens before it (``lookahead``), so tokens further from
the end of the buffer than that are final and leave it. Memory is constant in the length of text and of words. At
white space the machine is back in its first state, and so is the one for words at a word's end; so what it makes of a
chunk or a word between depends on nothing else, and is remembered in a bounded store. Decoding is a state machine over
token bytes that holds back only an unfinished UTF-8 sequence.
"""

from __future__ import annotations

import codecs
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.store import bound_batches, fresh
from siltstone.llm.words import batches_of, kept, tidy

#: White space, and the words of the tokenizer file's split pattern.
SPACE = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
LETTERS = regex.compile(r"\p{L}+")
OTHERS = regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]+")
#: What the machine makes of chunks and words up to this many bytes is remembered.
USUAL = 1024
#: Symbols up to which the next merge is found by looking at all of them.
FEW = 64
#: Chunks (and words) remembered in each of two generations, symbols merged at once beside the lookahead, and bytes of text split at once.
ROOM, STRIDE, PIECE = 150_000, 4096, 1 << 20
#: Above any rank.
NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


@cache
def joins_backwards() -> frozenset[str]:
    """Starters that normalisation may join with the character before them."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


class Vocabulary:
    """Token ids, merges and added tokens of a tokenizer file, and the lookahead that its merges need."""

    def __init__(self, path: str):
        data = json.loads(open(path, encoding="utf-8").read())
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(merges)}.get
        self.made = [self.ids[a + b] for a, b in merges]
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.added_pattern = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        letters = byte_letters()
        self.inner = [self.ids[x] for x in letters]
        self.last = [self.ids[x + self.suffix] for x in letters]
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.lookahead = self._lookahead(merges) + 1
        byte_of = {x: b for b, x in enumerate(letters)}
        self.token_bytes = {i: t.encode() for t, i in self.added.items()}
        for t, i in self.ids.items():
            if i not in self.token_bytes:
                stem, end = (t[: -len(self.suffix)], b" ") if self.suffix and t.endswith(self.suffix) else (t, b"")
                self.token_bytes[i] = bytes(byte_of[x] for x in stem) + end

    @staticmethod
    def _lookahead(merges: list[tuple[str, str]]) -> int:
        """Symbols before a place whose tokens may depend on what follows it.

        Up to the place where two texts part, their tokens agree until some merge (u, v) takes in the last agreed
        token u; then the agreed part ends before u. The next merge to reach further back is a later one, and its
        right side begins where u began, so it is u or was made with u as its leftmost part. The longest such chain
        of merges, measured in symbols of their left sides, bounds the way back. Taken from the last merge on, each
        merge adds its own left side to the best chain that may follow it.
        """
        made = {a + b: a for a, b in merges}
        size = {}

        def symbols(token: str) -> int:
            return size[token] if token in size else 1

        for a, b in merges:
            size[a + b] = symbols(a) + symbols(b)
        follows: dict[str, int] = {}
        longest = 0
        for a, b in reversed(merges):
            reach = symbols(a) + follows.get(a, 0)
            longest = max(longest, reach)
            part: str | None = b
            while part is not None:
                if follows.get(part, 0) < reach:
                    follows[part] = reach
                part = made.get(part)
        return longest

    def tokens(self, symbols: list[int]) -> list[int]:
        """Tokens of a list of symbols."""
        if len(symbols) > FEW:
            return self.merge(symbols)[0]
        rank, made, tokens = self.rank, self.made, list(symbols)
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(tokens, tokens[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            token = tokens[i] = made[least]
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(tokens[i - 1] << 32 | token, NONE)
            if i < len(ranks):
                ranks[i] = rank(token << 32 | tokens[i + 1], NONE)
        return tokens

    def merge(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Tokens of a list of symbols, and how many symbols each has. The lowest rank goes first, then the leftmost."""
        rank, n = self.rank, len(symbols)
        tokens, width = list(symbols), [1] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            least, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = self.made[least], -1
            width[i] += width[j]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank(tokens[x] << 32 | tokens[y])) is not None:
                    heapq.heappush(heap, (r, x, tokens[x], tokens[y]))
        live = [i for i in range(n) if tokens[i] >= 0]
        return [tokens[i] for i in live], [width[i] for i in live]


class WordStream:
    """Merges one word that arrives in pieces; emits tokens that no later byte can change."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.buffer, self.held = vocabulary, [], None

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for start in range(0, len(data), STRIDE):
            part = data[start : start + STRIDE]
            if self.held is not None:
                self.buffer.append(self.v.inner[self.held])
            self.buffer += [self.v.inner[b] for b in part[:-1]]
            self.held = part[-1]
            if len(self.buffer) >= STRIDE + self.v.lookahead:
                out += self._emit(len(self.buffer) - self.v.lookahead)
        return out

    def _emit(self, upto: int) -> list[int]:
        tokens, width = self.v.merge(self.buffer)
        out, end = [], 0
        for token, n in zip(tokens, width):
            if end + n > upto:
                break
            out.append(token)
            end += n
        del self.buffer[:end]
        return out

    def finish(self) -> list[int]:
        if self.held is None:
            return []
        out = self.v.tokens([*self.buffer, self.v.last[self.held]])
        self.buffer, self.held = [], None
        return out


def normal(text: str) -> str:
    """Composed and lower-cased character by character."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # str.lower() has another form for it at the end of a word
            return "".join(c.lower() for c in text)
    return text.lower()


class ChunkStream:
    """Encodes a chunk without ASCII white space that arrives in pieces of any size."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.raw, self.tail = vocabulary, "", ""
        self.word, self.run = WordStream(vocabulary), None
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def _added(self, piece: str) -> list[int]:
        """Take in a piece, up to the last added token in it."""
        self.raw += piece
        out: list[int] = []
        while found := self.v.added_pattern.search(self.raw):
            out += self._words(normal(self.raw[: found.start()]), True)
            out.append(self.v.added[found[0]])
            self.raw = self.raw[found.end() :]
        return out

    def feed(self, piece: str) -> list[int]:
        out = self._added(piece)
        cut = len(self.raw) - 1
        for token in self.v.added:  # the end may be the beginning of an added token
            for n in range(min(len(token) - 1, len(self.raw)), 0, -1):
                if self.raw.endswith(token[:n]):
                    cut = min(cut, len(self.raw) - n)
                    break
        while cut > 0 and (unicodedata.combining(self.raw[cut]) or not self.raw[cut].isascii() and self.raw[cut] in joins_backwards()):
            cut -= 1
        if cut > 0:
            ready, self.raw = self.raw[:cut], self.raw[cut:]
            out += self._words(normal(ready), False)
        return out

    def finish(self, piece: str = "") -> list[int]:
        """The rest, after a last piece; the machine is in its first state again."""
        out = self._added(piece)
        out += self._words(normal(self.raw), True)
        self.raw = ""
        return out

    def _whole(self, word: str) -> list[int]:
        """What the machine for words makes of a whole word."""
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = self.word.feed(word.encode()) + self.word.finish()
            if len(word) <= USUAL:
                if len(self.known) >= ROOM:
                    self.known, self.older = {}, self.known
                self.known[word] = ids
        return ids

    def _words(self, text: str, ended: bool) -> list[int]:
        text, out, at = self.tail + text, [], 0
        self.tail = ""
        if self.run is not None:
            found = self.run.match(text)
            if found:
                out += self.word.feed(found[0].encode())
                at = found.end()
            if at < len(text) or ended:
                out += self.word.finish()
                self.run = None
        if ended:
            known = self.known
            for word in WORD.findall(text, at):
                ids = known.get(word)
                out += self._whole(word) if ids is None else ids
        elif self.run is None:
            for found in WORD.finditer(text, at):
                if text[found.start()] == "'" and found.start() + 3 > len(text):  # perhaps 're and the like
                    self.tail = text[found.start() :]
                    break
                if found.end() == len(text):
                    if len(found[0]) < 8:  # it may yet become a longer word or another one
                        self.tail = found[0]
                        break
                    self.run = LETTERS if LETTERS.match(found[0]) else OTHERS
                    out += self.word.feed(found[0].encode())
                    break
                out += self._whole(found[0])
        return out


class Encoder(dict):
    """Packs the ids of texts as little-endian 32-bit integers; as a dict it remembers usual chunks.

    When it is full, it becomes the older generation and what that one held is forgotten, but for what is asked for
    again, so that frequent chunks stay.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.stream = ChunkStream(vocabulary)
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            text, out, start = chunk.decode("utf-8", "surrogatepass"), [], 0
            while len(text) - start > STRIDE:
                out += self.stream.feed(text[start : start + STRIDE])
                start += STRIDE
            out += self.stream.finish(text[start:])
            ids = struct.pack(f"<{len(out)}I", *out)
        if len(chunk) <= USUAL:
            if len(self) >= ROOM:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def pieces(self, text: str | None) -> Iterator[bytes]:
        """The packed ids of a text, piece by piece; a chunk's ids are the same in whatever piece it is."""
        data = (text or "").encode("utf-8", "surrogatepass")
        start = 0
        while start < len(data):
            stop = start + PIECE
            if stop < len(data):
                spaces = [data.rfind(s, start, stop) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")]
                stop = max(spaces) + 1
                if stop == 0:  # one chunk fills the piece: go on to its end
                    stop = next((m.end() for m in regex.finditer(rb"[ \t\n\r\x0b\x0c]", data, pos=start)), len(data))
            yield b"".join([self[w] for w in data[start:stop].split()])
            start = stop

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.pieces(text))


class Decoder:
    """An incremental byte-to-text machine over token ids.

    ``names=True`` gives what the library's decode gives for a file without a decoder: the tokens' own names with a
    blank between them. Otherwise the text: bytes of the tokens, word ends as blanks, malformed bytes replaced.
    """

    def __init__(self, vocabulary: Vocabulary, names: bool = False):
        self.v, self.names, self.begun = vocabulary, names, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        if self.names:
            known = self.v.names
            text = " ".join([known[i] for i in ids if i in known])
            text = " " + text if self.begun and text else text
            self.begun = self.begun or bool(text)
            return text
        return self.state.decode(b"".join([self.v.token_bytes.get(i, b"") for i in ids]))

    def finish(self) -> str:
        return "" if self.names else self.state.decode(b"", True)


def encoder(path: str) -> Encoder:
    """The worker's encoder: chunks stay known from task to task, until another operator's task begins there."""
    name = f"bpe {path}"
    known = kept.get(name)
    tidy()
    kept[name] = Encoder(load(path)) if known is None else known
    return kept[name]


@cache
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def _columns(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*docs.schema.fields, T.StructField(fresh(docs.columns, name), kind)])


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of each whole text, packed as little-endian unsigned 32-bit integers, as one more column.

    A null or empty text has no ids. Every other column is kept; where docs has one of the new column's name,
    underscores are put behind the new one's. The tokenizer file is read on the executors from ``path``.
    """
    schema, at = _columns(docs, ids, T.BinaryType()), docs.columns.index(text)
    bound_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in it:
            for start, texts in batches_of(batch.column(at)):
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([known.encode(t) for t in texts], pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", names: bool = False) -> DataFrame:
    """docs with the text of its packed ids (null: empty) as one more column; see Decoder for ``names``."""
    schema, at = _columns(docs, decoded, T.StringType()), docs.columns.index(ids)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in it:
            for start, blobs in batches_of(batch.column(at)):
                texts = []
                for blob in blobs:
                    machine, out = Decoder(vocabulary, names), []
                    values = np.frombuffer(blob or b"", dtype="<u4")
                    for k in range(0, len(values), PIECE):
                        out.append(machine.feed(values[k : k + PIECE].tolist()))
                    texts.append("".join([*out, machine.finish()]))
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """documents: ids of every whole text and their decoding, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = path or tokenizer_path()
    coded = decode_ids(encode_texts(docs, path).drop("text"), path, names=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Last pipeline stage: the columns of docs with the packed ids and what they decode to as a text."""
    path = path or tokenizer_path()
    ids, decoded, n = fresh(docs.columns, "ids"), fresh(docs.columns, "decoded"), fresh(docs.columns, "n_tokens")
    return decode_ids(encode_texts(docs, path, ids=ids), path, ids=ids, decoded=decoded).withColumn(n, (F.octet_length(ids) / 4).cast("long"))


QUERIES = {"op5_bpe": op5_bpe}
SQL: dict[str, str] = {}
