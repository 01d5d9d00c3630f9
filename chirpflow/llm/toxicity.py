"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context.

The lexicon (whole terms, and stems that any ending may follow) is learned from a
bounded sample of labelled rows: entries that stand almost only in toxic texts, and
there between many different neighbours (a word of a copied passage always has the
same ones, however many texts hold the passage). All entries form one trie. The Levenshtein automaton of a term accepts its misspellings;
the automata of all entries run together as sets of (trie node, edits so far), made
deterministic on demand and kept in a transition table, so a text's word costs one
table look-up per letter and most words leave the table after two or three letters.

A word within the allowed edits of a term is a misspelling unless the sample knows it as
a word of its own (it stands in several texts, mostly clean ones). Every match is classed by (entry, edits, context): a window of words on both sides
tells whether it stands in quotation marks or near a reporting verb. The share of
toxic rows per class, shrunk towards a prior, turns the strongest match into a score.

Defined results: null and empty texts score as texts without a match; repeated rows
are scored alike; without labelled rows the lexicon is empty and every score is the
prior; an empty table gives no rows; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.llm.common import bytes_list, crc_mod, give_back, rebatched
from chirpflow.session import read_table, scratch_path

#: About so many labelled rows (chosen by hash of doc_id) teach the lexicon and the classes.
FIT_ROWS = 40_000
#: An entry stands in so many toxic texts, and between so many different neighbours (words on each side).
MIN_SUPPORT = 8
NEIGHBOURS = 3
MIN_PRECISION = 0.9
STEM_LETTERS = range(4, 8)
#: A word in so many clean texts of the sample, more than in toxic ones, is no misspelling.
KNOWN_WORD = 2
CONTEXT = 6
THRESHOLD = 0.3
CACHE_WORDS = 300_000
BATCH_BYTES = 8 << 20
#: Quotation marks and reporting words (fixed values).
QUOTES = "\"“”„«»"
REPORTING = frozenset(
    "said says say wrote called calls quote quoted quotes word term phrase insult slur meaning "
    "sagte schrieb nannte zitat wort dit écrit appelé citation mot dijo escribió llamó cita palabra".split()
)
#: Prior share of toxic texts by edits of the strongest match; factor by context.
PRIOR = {0: 0.9, 1: 0.5, 2: 0.35}
CONTEXT_FACTOR = {0: 1.0, 1: 0.6, 2: 0.2}
PRIOR_WEIGHT = 4.0

_TOKEN = re.compile(r"[^\W_]+")


def chunk_tokens(chunk: str) -> list[str]:
    """Lower-cased tokens of a space-free chunk; if marks stand inside it, also the chunk
    without the marks around it ("id*ot")."""
    lowered = chunk.lower()
    tokens = _TOKEN.findall(lowered)
    if len(tokens) > 1:
        tokens.append(lowered.strip(QUOTES + ".,;:!?()[]{}'"))
    return tokens


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Product of a lexicon trie and its terms' Levenshtein automata, determinised lazily."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.most = [0]  # most edits any entry below the node allows
        self.term: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.entries = terms + stems
        for i, word in enumerate(self.entries):
            allowed = edits_allowed(word) if i < len(terms) else 0
            node = 0
            self.most[0] = max(self.most[0], allowed)
            for ch in word:
                child = self.next[node].get(ch)
                if child is None:
                    child = self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.most.append(0)
                    self.term.append(-1)
                    self.stem.append(-1)
                node = child
                self.most[node] = max(self.most[node], allowed)
            (self.term if i < len(terms) else self.stem)[node] = i
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accept: list[tuple[int, int] | None] = []  # (entry, edits) if a word ends here
        self.found: list[int] = []  # stem read exactly: any ending may follow
        self.table: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, reach: dict[int, int]) -> int:
        """Number of the state with these (node -> fewest edits); -1 for the empty set."""
        todo = list(reach.items())
        while todo:  # skipping a letter of the term costs an edit and reads nothing
            node, e = todo.pop()
            if e > reach.get(node, 99):
                continue
            for child in self.next[node].values():
                if e + 1 <= self.most[child] and e + 1 < reach.get(child, 99):
                    reach[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(reach.items())
        if not key:
            return -1
        known = self.states.get(key)
        if known is None:
            known = self.states[key] = len(self.sets)
            self.sets.append(key)
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= edits_allowed(self.entries[self.term[n]])]
            self.accept.append((min(ends)[1], min(ends)[0]) if ends else None)
            stems = [self.stem[n] for n, e in key if self.stem[n] >= 0 and e == 0]
            self.found.append(min(stems) if stems else -1)
        return known

    def _step(self, state: int, ch: str) -> int:
        reach: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e + 1 <= self.most[node]:
                reach[node] = min(reach.get(node, 99), e + 1)  # a letter too many
            for letter, child in self.next[node].items():
                cost = e if letter == ch else e + 1
                if cost <= self.most[child] and cost < reach.get(child, 99):
                    reach[child] = cost
        return self._state(reach)

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the best entry for a word, or None."""
        state, table = self.start, self.table
        best = None
        for ch in word:
            cell = (state, ch)
            following = table.get(cell)
            if following is None:
                if len(table) > 1_000_000:
                    table.clear()
                following = table[cell] = self._step(state, ch)
            if following < 0:
                return best
            state = following
            if best is None and self.found[state] >= 0:
                best = (self.found[state], 0)
        whole = self.accept[state]
        return whole if whole is not None and (best is None or whole[1] == 0) else best


class Matcher:
    """Matches of a text with their context class, with a bounded cache of words."""

    def __init__(self, terms: list[str], stems: list[str], known: frozenset = frozenset()):
        self.automaton = LexiconAutomaton(terms, stems)
        self.known = known  # words of their own within the edits of a term
        self.cache: dict[bytes, tuple[int, int] | None] = {}

    def forms(self, chunk: str) -> list[tuple[int, int, str]]:
        """(entry, edits, token) of the matching tokens of a chunk."""
        return [(*m, t) for t in chunk_tokens(chunk) if (m := self.automaton.match(t)) and not (m[1] and t in self.known)]

    def _chunk(self, chunk: bytes) -> tuple[int, int] | None:
        found = self.forms(chunk.decode("utf-8", "replace"))
        return min(found, key=lambda m: m[1])[:2] if found else None

    def matches(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(word position, entry, edits, context) of every match; context 0 plain, 1 quoted
        or reported, 2 both."""
        words = text.split()
        cache = self.cache
        out = []
        for at, w in enumerate(words):
            try:
                m = cache[w]
            except KeyError:
                m = self._chunk(w)
                if len(w) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = m
            if m is not None:
                out.append((at, m[0], m[1], self.context(words, at)))
        return out

    @staticmethod
    def context(words: list[bytes], at: int, window: int = CONTEXT) -> int:
        before = [w.decode("utf-8", "replace") for w in words[max(0, at - window) : at]]
        own = words[at].decode("utf-8", "replace")
        after = [w.decode("utf-8", "replace") for w in words[at + 1 : at + 1 + window]]
        left, right = " ".join([*before, own]), " ".join([own, *after])
        opened = any(q in left for q in QUOTES)
        closed = any(q in right for q in QUOTES)
        reported = any(t in REPORTING for w in before for t in _TOKEN.findall(w.lower()))
        return int(opened and closed) + int(reported)


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """(terms, stems) from rows (text, toxic): entries in at least MIN_SUPPORT toxic texts, between as many
    different neighbours, and in almost no other texts; a stem or term that a shorter stem covers as
    well is left out. Their number is bounded by the words of the sample's toxic texts."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = (Counter(), Counter())
        for batch in rebatched(batches, BATCH_BYTES, 0):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = {t for w in set((text or "").split()) for t in chunk_tokens(w)}
                keys = {"t" + t for t in tokens}
                keys.update(["s" + t[:n] for t in tokens for n in STEM_LETTERS if len(t) > n])
                tallies[1 if toxic else 0].update(keys)
        keys = list(tallies[0].keys() | tallies[1].keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([tallies[1][k] for k in part]), pa.array([tallies[0][k] for k in part])],
                ["entry", "bad", "good"],
            )

    table = sample.select("text", "toxic").mapInArrow(counts, "entry string, bad long, good long")
    table = table.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    chosen = table.where(
        (F.col("bad") >= MIN_SUPPORT) & (F.col("bad") >= MIN_PRECISION * (F.col("bad") + F.col("good") + 0.5))
    )
    bad = _neighbourhoods(sample, [r["entry"] for r in chosen.select("entry").collect()])
    stems: list[str] = []
    for s in sorted((k[1:] for k in bad if k[0] == "s"), key=lambda s: (len(s), s)):
        whole = [n for k, n in bad.items() if k[0] == "t" and k[1:].startswith(s)]
        # a stem earns its place by endings: no single term explains its texts
        if not any(s.startswith(x) for x in stems) and bad["s" + s] > 1.5 * max(whole, default=0):
            stems.append(s)
    terms = sorted(k[1:] for k in bad if k[0] == "t" and not any(k[1:].startswith(x) for x in stems))
    return terms, stems


def _neighbourhoods(sample: DataFrame, entries: list[str]) -> dict[str, int]:
    """Different neighbours (NEIGHBOURS words on each side) between which each entry stands in toxic texts (MIN_SUPPORT or more)."""
    shared = sample.sparkSession.sparkContext.broadcast(frozenset(entries))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in rebatched(batches, BATCH_BYTES, 0):
            found: set[tuple[str, int]] = set()
            for text in batch.column(0).to_pylist():
                words = (text or "").lower().split()
                for at, w in enumerate(words):
                    keys = {k for t in chunk_tokens(w) for k in ("t" + t, *("s" + t[:n] for n in STEM_LETTERS if len(t) > n)) if k in wanted}
                    if keys:
                        around = zlib.crc32(" ".join([*words[max(0, at - NEIGHBOURS) : at], "|", *words[at + 1 : at + 1 + NEIGHBOURS]]).encode())
                        found.update((k, around) for k in keys)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found]), pa.array([a for _, a in found], pa.int64())], ["entry", "around"])

    if not entries:
        return {}
    rows = sample.where("toxic = 1").select("text", "toxic").mapInArrow(places, "entry string, around long").distinct()
    counted = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SUPPORT)
    return {r["entry"]: r["n"] for r in counted.collect()}


def near_forms(sample: DataFrame, lexicon: tuple[list[str], list[str]]) -> list[tuple[str, int, int, int, int]]:
    """(form, entry, edits, clean texts, toxic texts) for every word of the sample within the edits of a term."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value)
        of_word: dict[str, list[tuple]] = {}
        tally: Counter = Counter()
        for batch in rebatched(batches, BATCH_BYTES, 0):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forms: set[tuple] = set()
                for w in set((text or "").split()):
                    if w not in of_word:
                        of_word[w] = [m for m in matcher.forms(w) if m[1]]
                    forms.update(of_word[w])
                tally.update((*f, 1 if toxic else 0) for f in forms)
        keys = list(tally)
        columns = [pa.array([k[2] for k in keys], pa.string()), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1, 3)]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([tally[k] for k in keys], pa.int64())], ["form", "entry", "edits", "toxic", "n"])

    rows = sample.select("text", "toxic").mapInArrow(near, "form string, entry long, edits long, toxic long, n long")
    toxic = F.col("toxic") == 1
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    table = rows.groupBy("form", "entry", "edits").agg(of(~toxic).alias("good"), of(toxic).alias("bad"))
    return [tuple(r) for r in table.collect()]  # at most the words of the sample


def known_words(forms: list[tuple[str, int, int, int, int]]) -> frozenset:
    """Forms that the sample knows as words of their own."""
    return frozenset(f for f, _, _, good, bad in forms if good >= KNOWN_WORD and good > bad)


def strongest(found: list[tuple[int, int, int, int]]) -> tuple[int, int, int]:
    """(entry, edits, context) of the match with the highest prior; (-1, 0, 0) if none."""
    if not found:
        return (-1, 0, 0)
    return max(((e, d, c) for _, e, d, c in found), key=lambda m: (PRIOR[m[1]] * CONTEXT_FACTOR[m[2]], -m[0]))


def class_shares(sample: DataFrame, lexicon: tuple[list[str], list[str]], known: frozenset = frozenset()) -> dict[tuple[int, int, int], float]:
    """P(toxic) per class of the strongest match, shrunk towards the prior; class
    (-1, 0, 0) holds the texts without a match."""
    shared = sample.sparkSession.sparkContext.broadcast((*lexicon, known))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value)
        tally: Counter = Counter()
        for batch in rebatched(batches, BATCH_BYTES, 0):
            for text, toxic in zip(bytes_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                tally[(*strongest(matcher.matches(text or b"")), 1 if toxic else 0)] += 1
        keys = list(tally)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.int64()) for i in range(4)] + [pa.array([tally[k] for k in keys], pa.int64())],
            ["entry", "edits", "context", "toxic", "n"],
        )

    rows = (
        sample.select("text", "toxic").mapInArrow(classes, "entry long, edits long, context long, toxic long, n long")
        .groupBy("entry", "edits", "context").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("toxic")).alias("bad")
        ).collect()
    )  # at most entries x 3 edits x 3 contexts
    table = [(r["entry"], r["edits"], r["context"], r["n"], r["bad"]) for r in rows]
    return {**shrunk_shares([r for r in table if not r[1]]), **misspelling_shares([*lexicon[0], *lexicon[1]], table)}


def misspelling_shares(entries: list[str], rows: list[tuple[int, int, int, int, int]]) -> dict[tuple[int, int, int], float]:
    """P(toxic) of texts whose strongest match is within the edits of an entry (and no known word), by
    (entry, edits, context), from rows (entry, edits, context, texts, toxic texts).

    Entries that begin alike (two letters) share their texts: where a language builds many words on one
    beginning, their neighbours are ordinary words. The prior counts as one text more, so an entry that
    stands alone keeps it."""
    tally: dict[tuple[str, int], list[int]] = {}
    for entry, edits, _, n, bad in rows:
        if entry >= 0 and edits:
            t = tally.setdefault((entries[entry][:2], edits), [0, 0])
            t[0] += n
            t[1] += bad
    out = {}
    for entry, name in enumerate(entries):
        for edits in (1, 2):
            n, bad = tally.get((name[:2], edits), (0, 0))
            for context, factor in CONTEXT_FACTOR.items():
                out[(entry, edits, context)] = (bad + PRIOR[edits]) * factor / (n + 1)
    return out


def shrunk_shares(rows: list[tuple[int, int, int, int, int]]) -> dict[tuple[int, int, int], float]:
    """Shares of the exact classes in three steps: prior, pooled over entries (entry -2), single entry."""
    pooled: dict[tuple[int, int], tuple[float, float]] = {}
    for entry, edits, context, n, bad in rows:
        if entry >= 0:
            x, y = pooled.get((edits, context), (0, 0))
            pooled[(edits, context)] = (x + n, y + bad)
    shares = {}
    for edits, p in PRIOR.items():
        for context, factor in CONTEXT_FACTOR.items():
            n, bad = (0, 0) if edits else pooled.get((edits, context), (0, 0))
            shares[(-2, edits, context)] = (bad + PRIOR_WEIGHT * p * factor) / (n + PRIOR_WEIGHT)
    for entry, edits, context, n, bad in rows:
        if entry < 0:
            shares[(-1, 0, 0)] = (bad + 0.5) / (n + 10.0)
        else:
            shares[(entry, edits, context)] = (bad + PRIOR_WEIGHT * shares[(-2, edits, context)]) / (n + PRIOR_WEIGHT)
    return shares


def score_text(found: list[tuple[int, int, int, int]], shares: dict) -> float:
    """The best class's share; further exact matches outside quotations move it part of the way to 1."""
    if not found:
        return min(0.2, shares.get((-1, 0, 0), 0.02))
    p, plain = 0.0, 0
    for _, entry, edits, context in found:
        share = shares.get((entry, edits, context), shares.get((-2, edits, context), 0.0))
        p = max(p, share)
        plain += edits == 0 and context == 0 and share >= 0.5
    return p + (1 - p) * 0.5 * (1 - 0.5 ** max(0, plain - 1))


def score_documents(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, score, n_matches, matches (word position, entry, edits, context) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, shares, known = shared.value
        matcher = Matcher(*lexicon, known)
        entries = matcher.automaton.entries
        match = pa.struct([("at", pa.int32()), ("entry", pa.string()), ("edits", pa.int32()), ("context", pa.int32())])
        for batch in rebatched(batches, BATCH_BYTES, 1):
            found = [matcher.matches(t or b"") for t in bytes_list(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([score_text(f, shares) for f in found], pa.float64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array(
                        [[{"at": a, "entry": entries[e], "edits": d, "context": c} for a, e, d, c in f] for f in found],
                        pa.list_(match),
                    ),
                ],
                ["doc_id", "score", "n_matches", "matches"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, score double, n_matches long, matches array<struct<at:int,entry:string,edits:int,context:int>>"
    )


def clean_documents(docs: DataFrame, model: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns (no join back)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, shares, known = shared.value
        matcher = Matcher(*lexicon, known)
        for batch in rebatched(batches, BATCH_BYTES, at):
            scores = [score_text(matcher.matches(t or b""), shares) for t in bytes_list(batch.column(at))]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))
        del matcher
        give_back()

    return docs.mapInArrow(run, docs.schema)


def _with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the smallest and the largest hash of a text's four-word windows."""
    for batch in rebatched(batches, BATCH_BYTES, 0):
        low, high = [], []
        for t in bytes_list(batch.column(0)):
            words = (t or b"").lower().split()
            marks = [zlib.crc32(b" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))]
            low.append(min(marks))
            high.append(max(marks))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1).cast(pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
            ["text", "toxic", "m1", "m2"],
        )


def fit_from_tables(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple:
    """Fit on the tables. The sample is chosen on the labels' ids, so that no text outside
    the bounded sample is shuffled."""
    spark = docs.sparkSession
    known = labels.where(
        F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)
    ).select(F.col("doc_id").alias("_id"), "toxic")
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * rows / total))
    ids = F.broadcast(known)  # about ``rows`` rows of two numbers
    sample = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"))
    # copies of one toxic text would make all its words look toxic: keep one text of those
    # whose smallest four-word window agrees or whose largest does
    sample = sample.select("text", "toxic").mapInArrow(_with_marks, "text string, toxic int, m1 long, m2 long")
    sample = sample.dropDuplicates(["m1"]).dropDuplicates(["m2"]).select("text", "toxic")
    path = scratch_path(spark, "toxic-sample")
    sample.write.parquet(path)
    sample = spark.read.parquet(path)
    lexicon = learn_lexicon(sample)
    known = known_words(near_forms(sample, lexicon))
    return lexicon, class_shares(sample, lexicon, known), known


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_from_tables(docs, read_table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return score_documents(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
