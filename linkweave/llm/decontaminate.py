"""Benchmark decontamination with a generalised suffix automaton over the words of normalised test items.

The automaton of all items has at most twice as many states as the items have words. Documents are streamed through it
word by word; the state gives the longest stretch of words, ending here, that occurs in any item. Where that reaches
the window (or a whole shorter item) its words are hit, and the state names the items.

Items go to executors in blocks of ``BLOCK_WORDS`` words: each block's automaton is broadcast with a bounded size, and
a larger benchmark takes several passes over the documents, whose hits are merged per row.

Defined cases: null and empty texts have no words; a very long text is streamed whole, its words held at once; an empty
documents table gives no rows; an item without words, or with a null text, matches nothing; an item
with a null id marks words as hit but isn't listed; equal item ids count once; repeated documents each give a row; an
empty benchmark hits nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.runtime import beside, pick, settle, ship

#: Words of a window: consecutive words of an item that mark a document's words as hit.
WINDOW = 10
#: Words of items that one broadcast automaton holds.
BLOCK_WORDS = 200_000
#: Pipeline: a document with a larger part of its words hit goes altogether.
MAX_COVERAGE = 0.5

# Words are runs of ASCII digits and letters and of all characters from U+0080; in UTF-8 these are bytes from 0x80.
_KEEP = bytes(c if chr(c).isdigit() or chr(c).islower() or c >= 0x80 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_KEEP).split() if text else []


class Automaton:
    """Generalised suffix automaton over word sequences, with the item ids of each window."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.n_ids = 0
        self.ids: list[str | None] = []
        self.hits: list[tuple | None] = []

    def _clone(self, p: int, q: int, word: bytes) -> int:
        copy = len(self.step)
        self.step.append(self.step[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        q = self.step[last].get(word)
        if q is not None:  # this stretch is there from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        new = len(self.step)
        self.step.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return new

    def build(self, items: list[tuple[str | None, list[bytes]]]) -> Automaton:
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        found: list[dict[int, set[int]]] = [{} for _ in self.step]  # by state: windows that end there, by length
        for n, (name, words) in enumerate(items):
            self.ids.append(name)
            k = min(self.window, len(words))
            state = size = 0
            for word in words:
                state, size = self.step[state][word], size + 1
                while size > k and self.length[self.link[state]] >= k:
                    state = self.link[state]
                if size >= k:
                    found[state].setdefault(k, set()).add(n)
                size = min(size, k)
        # What ends at a state also ends where its link leads; links have fewer words, so they go first.
        self.hits = [None] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            above = self.hits[self.link[state]] or ()
            own = tuple((k, tuple(sorted(v))) for k, v in sorted(found[state].items(), reverse=True))
            self.hits[state] = (own + above) or None
        return self

    def spans(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Disjoint [start, end) word spans that are hit, and the numbers of the items."""
        step, link, length, hits = self.step, self.link, self.length, self.hits
        spans: list[list[int]] = []
        items: set[int] = set()
        state = size = 0
        for at, word in enumerate(words, 1):
            nxt = step[state].get(word)
            if nxt is None:
                if not state:
                    continue
                while nxt is None and state:
                    state = link[state]
                    nxt = step[state].get(word)
                size = length[state]
                if nxt is None:
                    size = 0
                    continue
            state = nxt
            size += 1
            if hits[state] is not None:
                longest = 0
                for k, who in hits[state]:
                    if k <= size:
                        items.update(who)
                        longest = longest or k
                if longest:
                    start = at - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, at])
        return spans, items


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of bounded words (one item at least), streamed to the driver block by block."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        words = words_of(bytes(row[1])) if row[1] is not None else []
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


def _merge(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _scan(rows: DataFrame, automaton) -> DataFrame:
    """From (row, doc_id, text): (row, doc_id, n_words, spans, items)."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        machine = automaton.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = words_of(text.as_py())
                hit, who = machine.spans(words)
                n_words.append(len(words))
                spans.append(hit)
                items.append([machine.ids[n] for n in who if machine.ids[n] is not None])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "spans", "items"],
            )

    return rows.mapInArrow(run, f"row long, doc_id {id_type}, n_words long, spans array<array<bigint>>, items array<string>")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: row, doc_id, n_words, spans ([start, end) in words, merged) and items (distinct ids, sorted)."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    automata = _automata(benchmark, window, block_words)
    return _find(settle(rows, "decontamination-rows") if len(automata) > 1 else rows, automata)  # passes meet by their rows' numbers


def _automata(benchmark: DataFrame, window: int, block_words: int) -> list:
    """Broadcast automata of the blocks, one at least."""
    tests = pick(benchmark, item_id="item_id", text="text")
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(Automaton(window).build(b)) for b in _blocks(tests, block_words)] or [context.broadcast(Automaton(window).build([]))]


def _find(rows: DataFrame, automata: list) -> DataFrame:
    """``find`` from (row, doc_id, text)."""
    passes = [_scan(rows, automaton) for automaton in automata]
    if len(passes) == 1:
        return passes[0].withColumn("items", F.array_sort(F.array_distinct("items")))
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    merge = F.pandas_udf(lambda s: s.map(lambda x: _merge([list(y) for y in x])), "array<array<bigint>>")
    return (
        every.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        .withColumn("spans", merge("spans"))
        .withColumn("items", F.array_sort(F.array_distinct("items")))
    )


def n_hit(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))


def cut_spans(text: str, spans: list) -> str:
    """``text`` without the words of ``spans`` and the characters between them."""
    data = text.encode()
    plain = data.translate(_KEEP)
    edges, at = [], 0
    for word in plain.split():
        at = plain.index(word, at)
        edges.append((at, at + len(word)))
        at += len(word)
    out, last = [], 0
    for start, end in spans:
        out.append(data[last : edges[start][0]])
        last = edges[end - 1][1]
    out.append(data[last:])
    return b"".join(out).decode()


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with hit spans cut out of the text, without documents of which more than ``max_coverage`` is hit.

    Both go by the spans of all blocks in the text as it came. Other columns stay; ``n_chars``, if there as a long,
    follows the text. Documents without a hit stay as they were.
    """
    ship(docs.sparkSession)
    plain, at = beside(docs)
    automata = _automata(benchmark, window, block_words)
    if len(automata) == 1:
        return _cut(plain, docs, text_col, max_coverage, automata[0]).toDF(*docs.columns)
    table = settle(plain.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    found = _find(table.select("row", F.col("row").alias("doc_id"), at[text_col].alias("text")), automata)
    hits = found.filter(F.size("spans") > 0).select("row", "spans")
    return _cut(table.join(hits, "row", "left").drop("row"), docs, text_col, max_coverage).drop("spans").toDF(*docs.columns)


def _cut(rows: DataFrame, docs: DataFrame, text_col: str, max_coverage: float, automaton=None) -> DataFrame:
    """``rows`` of ``docs``, cut by ``automaton`` or else by their last column, ``spans``."""
    place = docs.columns.index(text_col)
    chars = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[place].to_pylist()
            sizes = columns[chars].to_pylist() if chars is not None else None
            given = columns[-1].to_pylist() if automaton is None else None
            keep = []
            for k, text in enumerate(texts):
                words = words_of(text.encode()) if text and (given is None or given[k]) else []
                spans = (automaton.value.spans(words)[0] if given is None else given[k]) if words else []
                keep.append(sum(b - a for a, b in spans) <= max_coverage * len(words))
                if spans and keep[-1]:
                    texts[k] = cut_spans(text, spans)
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            columns[place] = pa.array(texts, columns[place].type)
            if sizes is not None:
                columns[chars] = pa.array(sizes, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, tests = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find(docs, tests)
    return found.select(
        "doc_id",
        "n_words",
        n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT r, p, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
