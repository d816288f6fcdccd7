"""Secret scans with multipart credential linking.

Base findings stand alone: assignments of long values, access identifiers and long runs of hex digits. Weak candidates
(bare keys, identifiers without a known prefix, endpoints) are reported only where complementary parts lie in the same
scope and within reach: a key needs an identifier, an identifier needs a secret, an endpoint needs both. Parts of a
document are joined as intervals, by their sorted starts and ends: those that end within reach before a part, or begin
within reach after it. Parts that overlap never complement each other, so one value isn't taken for two parts. A scope
ends at an empty line.

Defined cases: a null text counts as empty; a very long text is scanned whole, and a part meets only what lies within
reach; repeated rows are scanned each; an empty table gives no rows; other columns are ignored, whatever their names.
Places are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from linkweave.runtime import beside, pick, ship

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 12, "access": 18}

#: Weak candidates: a bare key, an identifier, an endpoint.
KEY = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_.-])")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,24}(?![A-Za-z0-9])")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+""")
BLANK = re.compile(r"\n[ \t\r]*\n")
#: Characters between two parts that belong together.
REACH = 300
KINDS = ("assign", "access", "hex", "key", "identifier", "endpoint")

Span = tuple[int, int]


def base_spans(text: str) -> dict[str, list[Span]]:
    low = text.lower()
    assign = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]] if any(x in low for x in KEYWORDS) else []
    access = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]] if "AKIA" in text else []
    return {"assign": assign, "access": access, "hex": [m.span() for m in HEX.finditer(text)]}


class Parts:
    """Intervals to be joined with others of the same scope, within reach and apart from them."""

    def __init__(self, spans: list[Span], breaks: list[int], reach: int):
        self.by_start, self.by_end = sorted(spans), sorted(spans, key=lambda x: x[1])
        self.starts, self.ends = [x[0] for x in self.by_start], [x[1] for x in self.by_end]
        self.breaks, self.reach = breaks, reach

    def beside(self, span: Span) -> list[Span]:
        """The parts that meet ``span``: few, as they lie within reach."""
        start, end = span
        before = self.by_end[bisect_left(self.ends, start - self.reach) : bisect_right(self.ends, start)]
        after = self.by_start[bisect_left(self.starts, end) : bisect_right(self.starts, end + self.reach)]
        scope = bisect_left(self.breaks, start)
        return [x for x in before + after if bisect_left(self.breaks, x[0]) == scope]


def _apart(some: list[Span], others: list[Span]) -> bool:
    """Whether one of ``some`` and one of ``others`` don't overlap."""
    ends, starts = (min((x[1] for x in v), default=0) for v in (some, others)), (max((x[0] for x in v), default=-1) for v in (others, some))
    return bool(some and others) and any(a <= b for a, b in zip(ends, starts, strict=True))


def linked_spans(text: str, base: dict[str, list[Span]], reach: int = REACH) -> dict[str, list[Span]]:
    taken = sorted(x for v in base.values() for x in v)
    until = list(accumulate((x[1] for x in taken), max))  # base findings may overlap

    def free(found) -> list[Span]:
        """Those that no base finding overlaps."""
        out = []
        for m in found:
            k = bisect_left(taken, (m.end(), -1))
            if not (k and until[k - 1] > m.start()):
                out.append(m.span())
        return out

    keys = free(KEY.finditer(text))
    none: dict[str, list[Span]] = {"key": [], "identifier": [], "endpoint": []}
    if not base["assign"] and not keys:
        return none
    identifiers = free(IDENTIFIER.finditer(text))
    if not base["access"] and not identifiers:
        return none
    breaks = [m.start() for m in BLANK.finditer(text)]
    ids, secrets = (Parts(x, breaks, reach) for x in (base["access"] + identifiers, base["assign"] + keys))
    kept_keys = [x for x in keys if ids.beside(x)]
    kept_ids = [x for x in identifiers if secrets.beside(x)]
    ids, secrets = (Parts(x, breaks, reach) for x in (base["access"] + kept_ids, base["assign"] + kept_keys))
    ends = [x for x in free(ENDPOINT.finditer(text)) if _apart(secrets.beside(x), ids.beside(x))]
    return {"key": kept_keys, "identifier": kept_ids, "endpoint": ends}


def scan(text: str | None) -> dict[str, list[Span]]:
    base = base_spans(text or "")
    return base | linked_spans(text or "", base)


def listed(found: dict[str, list[Span]], kinds=KINDS) -> str:
    """``kind:start:end`` by start, then by kind as listed, joined by commas."""
    order = sorted((a, kinds.index(k), b) for k in kinds for a, b in found.get(k, ()))
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in order)


def redact(text: str, found: dict[str, list[Span]]) -> str:
    """``text`` with the value of each finding replaced by ``[secret]``; names of assignments and endpoints stay."""
    assigned = set(found["assign"])
    values = [m.span(2) for m in ASSIGN.finditer(text) if m.span() in assigned] if assigned else []
    values += [x for k in ("access", "hex", "key", "identifier") for x in found[k]]
    out, last = [], 0
    for a, b in sorted(values):
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], "[secret]"]
        last = b
    return "".join([*out, text[last:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, findings (kind, start, end), counts of base kinds, digest of base findings and all as text."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in batch.column("text"):
                found = scan(text.as_py())
                for k in KINDS[:3]:
                    out[f"n_{k}"].append(len(found[k]))
                out["base_sha256"].append(hashlib.sha256(listed(found, KINDS[:3]).encode()).hexdigest())
                out["spans"].append(listed(found))
            arrays = [pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *out])

    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with findings redacted; ``n_chars``, if there as a long, follows the text. No row goes."""
    ship(docs.sparkSession)
    plain, _ = beside(docs)
    place = docs.columns.index(text_col)
    chars = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[place].to_pylist()
            sizes = columns[chars].to_pylist() if chars is not None else None
            for k, text in enumerate(texts):
                if text and any((found := scan(text)).values()):
                    texts[k] = redact(text, found)
                    if sizes is not None and texts[k] != text:
                        sizes[k] = len(texts[k])
            columns[place] = pa.array(texts, columns[place].type)
            if sizes is not None:
                columns[chars] = pa.array(sizes, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
