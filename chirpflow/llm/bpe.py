"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in rank order, into a deterministic automaton whose arcs
are tokens: start with one state looping on every base symbol; for each merge
(a, b) -> c a *merge gadget* is applied. On every path q -a-> p -b-> r it

* adds an arc q -c-> r (c may follow whatever a may follow, and whatever may
  follow b may follow c), and
* splits p so that b can no longer be read after a.

After the last merge the automaton accepts exactly the correct tokenizations. The
state after a token depends on that token alone, so a state is named by its last
token. Gadgets copy a row (successors of c = those of b so far) and a column
(predecessors of c = those of a so far); the automaton keeps these copies as links
with the time of the copy and fills a transition-table cell when it is first read.
A word is encoded by walking its letters: at each place exactly one token ends the
correct tokenization of the prefix, found by table look-ups. Decoding emits the
labels of the arcs (one per id).

Defined results: a null text is encoded as an empty one (no ids, empty decoding);
every row is treated alike, repeated or not; an empty table gives no rows; other
columns are ignored; texts of any length are processed in batches of bounded bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from chirpflow.llm.common import bytes_list, documents_only, give_back, rebatched
from chirpflow.session import read_table

TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 300_000
BATCH_BYTES = 8 << 20
#: Unicode white space, spelled out (fixed values).
UNICODE_SPACE = "\t-\r \x85\xa0  -     　"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class TokenAutomaton:
    """Deterministic automaton over tokens, built from (left, right) merges in rank order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.labels = [""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.labels[i] = token
        self.end = end
        size = len(self.labels)
        self.left, self.right, self.time = [-1] * size, [-1] * size, [-1] * size
        self.gadget: dict[int, int] = {}  # a * size + b -> time at which b stops following a
        self.size = size
        self.table: dict[int, bool] = {}
        self.unreachable: set[int] = set()
        for k, (a, b) in enumerate(merges):
            self._merge(k, vocab[a], vocab[b], vocab[a + b])
        # arcs by spelling; a label's end mark is part of its spelling
        self.by_text = vocab
        # letters of the longest arc that starts with these four letters (3 if there is none)
        self.reach: dict[str, int] = {}
        for t in vocab:
            bare = t.removesuffix(end) if end else t
            if len(bare) > 3:
                self.reach[bare[:4]] = max(self.reach.get(bare[:4], 0), len(bare))

    def _merge(self, k: int, a: int, b: int, c: int) -> None:
        """Apply the k-th merge gadget: split after a, copy column a and row b for c."""
        if self.time[a] >= k or self.time[b] >= k or self.time[c] >= 0:
            raise ValueError("merges must be in the order of a training run: parts first, each result once")
        if a in self.unreachable or b in self.unreachable or not self._arc(a, b, k):
            self.unreachable.add(c)  # b never stands after a: the gadget changes no path
        self.gadget[a * self.size + b] = k
        self.left[c], self.right[c], self.time[c] = a, b, k

    def follows(self, a: int, b: int) -> bool:
        """Whether the state after ``a`` has an arc ``b``; the cell is filled on first use."""
        cell = a * self.size + b
        known = self.table.get(cell)
        if known is None:
            if len(self.table) > 4_000_000:
                self.table.clear()
            known = self.table[cell] = b not in self.unreachable and self._arc(a, b, len(self.gadget) + 1)
        return known

    def _arc(self, u: int, v: int, now: int) -> bool:
        """Whether u -> v is an arc at time ``now``. Follow the copies back in time; a gadget counts if it came before the copy.
        A column copy is taken after its own gadget's split, a row copy before it."""
        time, gadget, size = self.time, self.gadget, self.size
        while True:
            k = gadget.get(u * size + v)
            if k is not None and k < now:
                return False
            if time[u] < 0 and time[v] < 0:
                return True
            if time[v] >= time[u]:
                now = time[v] + 1  # the column of v was copied from its left part, after the split
                v = self.left[v]
            else:
                now = time[u]  # the row of u was copied from its right part, before the split
                u = self.right[u]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word: walk the transition table over its letters.

        From each place the longest arc that the current state allows is tried first;
        a place without a way to the end is marked dead and never entered again (the
        state at a place is the same however it is reached), so work stays linear in
        the number of (place, arc) pairs.
        """
        n = len(word)
        if not n:
            return []
        get, table, size, reach = self.by_text.get, self.table, self.size, self.reach.get
        marked = word + self.end
        starts: list[int] = []
        states: list[int] = []
        dead: set[int] = set()
        pos, last, end = 0, -1, min(n, reach(word[:4], 3))
        while True:
            while end > pos:
                t = get(word[pos:end]) if end < n else get(marked[pos:])
                if t is not None and end not in dead:
                    if last < 0:
                        allowed = t not in self.unreachable
                    else:
                        allowed = table.get(last * size + t)
                        if allowed is None:
                            allowed = self.follows(last, t)
                    if allowed:
                        break
                end -= 1
            else:
                if not starts:
                    raise ValueError(f"no correct tokenization of {word!r}: a base symbol is missing")
                dead.add(pos)
                states.pop()
                end, pos = pos - 1, starts.pop()
                last = states[-1] if states else -1
                continue
            starts.append(pos)
            states.append(t)
            if end == n:
                return states
            pos, last = end, t
            end = min(n, pos + reach(word[pos : pos + 4], 3))


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others get letters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Lower-casing word-level BPE read from a tokenizer file: normalise, split, encode, decode."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = self.automaton.labels
        for content, i in self.special.items():
            labels += [""] * (i + 1 - len(labels))
            labels[i] = content
        self.label_bytes = [t.encode() for t in labels]
        contents = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, contents)) + ")") if contents else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace("\\s", UNICODE_SPACE))
        self.letters = byte_letters()
        self.cache_words = cache_words
        self.pieces: dict[str, tuple[int, bytes, bytes]] = {}
        self.chunks: dict[bytes, tuple[int, bytes, bytes]] = {}

    def forget(self) -> None:
        """Empty the caches of words."""
        self.pieces.clear()
        self.chunks.clear()

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then each character's own lower case (no word-final forms)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def _rendered(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        labels = self.label_bytes
        return len(ids), " ".join(map(str, ids)).encode(), b" ".join([labels[i] for i in ids])

    def _plain(self, text: str) -> list[tuple[int, bytes, bytes]]:
        """One (count, ids, labels) per piece of a text without special tokens."""
        out = []
        pieces = self.pieces
        for piece in self.split.findall(self.normalise(text)):
            known = pieces.get(piece)
            if known is None:
                if len(pieces) >= self.cache_words:
                    pieces.clear()
                word = piece if piece.isalnum() and piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
                known = pieces[piece] = self._rendered(self.automaton.encode_word(word))
            out.append(known)
        return out

    def _parts(self, text: str) -> list[tuple[int, bytes, bytes]]:
        """As _plain; special tokens written out in the text count as pieces."""
        if self.special_split is None or "<" not in text:
            return self._plain(text)
        out = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(self._rendered([self.special[part]]))
            elif part:
                out += self._plain(part)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens written out in it get their ids."""
        return [int(i) for part in self._parts(text) for i in part[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Arc labels joined by one space (the file names no decoder)."""
        return b" ".join([self.label_bytes[i] for i in ids]).decode()

    def _chunk(self, chunk: bytes) -> tuple[int, bytes, bytes]:
        parts = self._parts(chunk.decode("utf-8", "replace"))
        if len(parts) == 1:
            return parts[0]
        return sum([p[0] for p in parts]), b" ".join([p[1] for p in parts]), b" ".join([p[2] for p in parts])

    def digest(self, text: bytes) -> tuple[int, bytes, bytes]:
        """(number of ids, ids in decimal, decoded text) of a whole text.

        No rule of the file reaches across ASCII white space, so a text is the
        sequence of its space-free chunks; chunks seen before come from a bounded cache.
        """
        chunks = text.split()
        cache = self.chunks
        n, ids, labels = 0, [], []
        for c in chunks:
            found = cache.get(c)
            if found is None:
                found = self._chunk(c)
                if len(c) <= 64:
                    if len(cache) >= self.cache_words:
                        cache.clear()
                    cache[c] = found
            if found[0]:
                n += found[0]
                ids.append(found[1])
                labels.append(found[2])
        return n, b" ".join(ids), b" ".join(labels)


_MODELS: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The model of a file, compiled once per Python worker."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def _resolve(path: str | None) -> str:
    return path if path and os.path.exists(path) else tokenizer_path(os.path.basename(path or TOKENIZER))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded text: the operator's real output."""
    name = path or TOKENIZER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(_resolve(name))
        for batch in rebatched(batches, BATCH_BYTES, 1):
            found = [model.digest(t or b"") for t in bytes_list(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([list(map(int, f[1].split())) for f in found], pa.list_(pa.int32())),
                    pa.array([f[2].decode() for f in found], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    docs = documents_only(docs, "doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the decimal ids and of the decoded text.

    Same encoder and decoder as ``encode_documents``; only the digests leave the task.
    """
    name = path or TOKENIZER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(_resolve(name))
        sha = hashlib.sha256
        for batch in rebatched(batches, BATCH_BYTES, 1):
            counts, ids, texts = [], [], []
            for t in bytes_list(batch.column(1)):
                n, i, d = model.digest(t or b"")
                counts.append(n)
                ids.append(sha(i).hexdigest())
                texts.append(sha(d).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        # the compiled model stays with the worker, the words of this task do not
        model.forget()
        give_back()

    docs = documents_only(docs, "doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"))
