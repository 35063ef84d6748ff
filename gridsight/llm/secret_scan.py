"""Secret scans with a trigram inverted index.

From the parse tree of each rule's pattern a Boolean query over trigrams is derived that
every match must satisfy. For each block of texts the index holds one posting bitmap per
trigram that some rule asks for, made in one pass over the trigrams of the block. Queries are evaluated by intersecting and uniting
postings, and the pattern itself is run on the candidates only. A rule whose pattern has
no mandatory trigram (long runs of hex digits) is run on every text.

Blocks are Arrow batches, so the index lives and dies with a batch: nothing is shuffled
or written, and a lost task is simply run again. Trigrams are taken from ASCII-lower-cased
texts, so one index serves rules in either case and never loses a match.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned
alike; offsets are code points, ends exclusive; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op  # the standard library's own pattern parser
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.llm.registry import fresh, query, read, slices, with_texts

#: Most literal texts followed at once while a pattern is read; beyond it the text so far
#: is turned into trigrams. Only the sharpness of the filter depends on it.
MAX_TEXTS = 24
#: Bytes of a block whose trigrams are looked up at once.
SLICE = 1 << 20
#: The byte that stands for each byte in folded texts: only A-Z are lowered.
LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.int32)


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` took part and has `least` characters or more."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


#: The base patterns.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=8, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
# A private key: from its BEGIN marker to its END marker, or, where another marker or the end of
# the text comes first, over the lines that look like a key (header fields, long runs of base64,
# a short last line). Possessive, so that a text is read once between two markers.
_BREAK = r"""(?:\\[rnt]|[\s"'`>#*|,;\\-]|\+(?=\s))*+"""
_PRIVATE_KEY = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:"
    r"(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_BREAK}[A-Za-z][A-Za-z-]*:\x20[^\r\n\\]*+)*+(?:{_BREAK}[A-Za-z0-9+/]{{20,}}+={{0,2}})++"
    rf"(?:{_BREAK}(?:=[A-Za-z0-9+/]{{4}}|[A-Za-z0-9+/]+=*(?=[\s\"'\\]|\Z)))?"
    rf"|{_BREAK}[A-Za-z0-9+/]+=*\Z)?")
# Three joined runs; a run that no other one follows is passed over whole, as a later start in it
# would fail too. So a text is read a fixed number of times, however often a run says "eyJ".
_RUN = r"eyJ[A-Za-z0-9_-]++"
_JWT = rf"({_RUN}\.{_RUN}\.[A-Za-z0-9_-]+)|{_RUN}"
#: Published key formats.
ADDED_RULES = (
    Rule("private_key", _PRIVATE_KEY),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", _JWT, group=1, least=30),
)
RULES = BASE_RULES + ADDED_RULES

# A trigram query: True (no demand), a trigram, or ("and" | "or", parts).


def _all_of(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _folded(point: int) -> str:
    """The character as it stands in folded texts: only A-Z are lowered."""
    return chr(point).lower() if point < 128 else chr(point)


def _of_texts(texts: frozenset[str]) -> object:
    """The query of a part that reads as one of `texts`."""
    return _any_of([_all_of([t[i:i + 3] for i in range(len(t) - 2)]) for t in sorted(texts)])


def _read(items) -> tuple[frozenset[str] | None, object]:
    """(all texts the items can match, if few; the query of the items)."""
    texts: frozenset[str] | None = frozenset([""])
    demands, exact = [], True

    def close() -> None:
        nonlocal texts, exact
        demands.append(_of_texts(texts))
        texts, exact = frozenset([""]), False

    for code, value in items:
        inner: frozenset[str] | None = None
        demand: object = True
        if code is op.LITERAL:
            inner = frozenset([_folded(value)])
        elif code is op.IN and value[0][0] is not op.NEGATE and all(c is op.LITERAL for c, _ in value):
            inner = frozenset(_folded(v) for _, v in value)
        elif code is op.SUBPATTERN:
            inner, demand = _read(value[-1])
        elif code is op.BRANCH:
            branches = [_read(b) for b in value[1]]
            if all(t is not None for t, _ in branches):
                inner = frozenset().union(*(t for t, _ in branches))
            demand = _any_of([q if t is None else _of_texts(t) for t, q in branches])
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = value
            inside, demand = _read(body)
            if (low, high) == (0, 1) and inside is not None:
                inner = inside | {""}
            demand = demand if low else True
        elif code is op.AT:
            inner = frozenset([""])
        if inner is not None and len(texts) * len(inner) <= MAX_TEXTS:
            texts = frozenset(a + b for a in texts for b in inner)
        else:
            close()
            if inner is not None and len(inner) <= MAX_TEXTS:
                texts = inner
            else:
                demands.append(demand)
    if exact:
        return texts, _of_texts(texts)
    demands.append(_of_texts(texts))
    return None, _all_of(demands)


def trigram_query(pattern: str) -> object:
    """What every match of `pattern` demands of the trigrams of its lower-cased text."""
    return _read(parser.parse(pattern))[1]


def trigrams_of(wanted: object) -> set[str]:
    if wanted is True:
        return set()
    return {wanted} if isinstance(wanted, str) else set().union(*map(trigrams_of, wanted[1]))


class Trigrams:
    """The trigrams that rules ask for, as a table over all codes of three bytes."""

    def __init__(self, trigrams: set[str]):
        # The first three bytes of a trigram beyond ASCII are a demand as well.
        codes = {t: int.from_bytes(t.encode()[:3], "big") for t in sorted(trigrams)}
        numbers = {code: i + 1 for i, code in enumerate(dict.fromkeys(codes.values()))}
        self.number = {t: numbers[code] for t, code in codes.items()}
        self.table = np.zeros(1 << 24, np.min_scalar_type(len(numbers)))
        self.table[list(numbers)] = list(numbers.values())
        self.size = len(numbers)

    def postings(self, texts: pa.Array) -> dict[str, pa.Array]:
        """The inverted index of a block: for each trigram, the bitmap of texts that have it.

        Every trigram of the block is looked up once, however many are asked for.
        """
        found = np.zeros((self.size + 1, len(texts)), bool)
        _, ends, content = texts.buffers()
        if len(texts) and content is not None:
            wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            ends = np.frombuffer(ends, wide)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(content, np.uint8)[:ends[-1]]
            for begin in range(ends[0], len(data) - 2, SLICE):
                part = LOWERED[data[begin:begin + SLICE + 2]]
                number = self.table[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
                at = np.flatnonzero(number)
                number = number[at]
                at += begin
                row = np.searchsorted(ends, at, "right") - 1
                inside = at + 3 <= ends[row + 1]
                found[number[inside], row[inside]] = True
        return {t: pa.array(found[i]) for t, i in self.number.items()}


def candidates(wanted: object, index: dict[str, pa.Array], rows: int) -> pa.Array:
    """The bitmap of texts that satisfy a query."""
    if wanted is True:
        return pa.array([True] * rows, pa.bool_())
    if isinstance(wanted, str):
        return index[wanted]
    join = pc.and_ if wanted[0] == "and" else pc.or_
    found = candidates(wanted[1][0], index, rows)
    for part in wanted[1][1:]:
        found = join(found, candidates(part, index, rows))
    return found


def compiled(rule: Rule) -> re.Pattern:
    """The rule's pattern; a plain run of one class is asked for at its least length at
    once, as a shorter run is dropped whole anyway."""
    pattern = rule.pattern
    if rule.group == 0 and re.fullmatch(r"\[[^\[\]\\]+\]\+", pattern):
        pattern = f"{pattern[:-1]}{{{max(1, rule.least)},}}"
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType())])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
                 keep: tuple[str, ...] = ("doc_id",), into: str = "spans") -> DataFrame:
    """The columns `keep` and `into`, an array of (kind, start, end) by start, then rule."""
    wanted = [trigram_query(r.pattern) for r in rules]
    trigrams = set().union(*map(trigrams_of, wanted)) if rules else set()
    patterns = [compiled(r) for r in rules]
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField(into, T.ArrayType(SPAN))])
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    n = len(keep)
    sent, place = with_texts(docs, keep, text_col, "_scanned")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted_trigrams = Trigrams(trigrams)
        for batch in slices(batches):
            texts = pc.fill_null(batch.column(place), "")
            index = wanted_trigrams.postings(texts)
            spans: list[list[tuple[int, int, str, int]]] = [[] for _ in range(batch.num_rows)]
            for order, (rule, demand, pattern) in enumerate(zip(rules, wanted, patterns)):
                hits = pc.indices_nonzero(candidates(demand, index, batch.num_rows))
                for row in hits.to_pylist():
                    for m in pattern.finditer(texts[row].as_py()):
                        found = m.group(rule.group)
                        if found is not None and len(found) >= rule.least:
                            spans[row].append((m.start(), order, rule.kind, m.end()))
            out = [[{"kind": k, "start": s, "end": e} for s, _, k, e in sorted(x)] for x in spans]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n)), pa.array(out, span_type)],
                [*keep, into])

    return sent.mapInArrow(scan, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by [kind]; of overlapping spans the first, and from
    there on whatever reaches further, is cut out as one. Null texts stay null."""
    names = docs.columns
    spans = fresh(names, "_spans")
    found = find_secrets(docs, rules, text_col, tuple(names), spans)
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        begin = (state["at"] + 1).cast("int")
        piece = F.when(fresh, F.concat(
            F.substr(text, begin, (span["start"] - state["at"]).cast("int")),
            F.lit("["), span["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["out"], piece).alias("out"),
                        F.greatest(state["at"], span["end"]).alias("at"))

    def rest(state: Column) -> Column:
        return F.concat(state["out"], F.substr(text, (state["at"] + 1).cast("int")))

    cleaned = F.when(F.size(spans) > 0, F.aggregate(spans, start, cut, rest)).otherwise(text)
    return found.select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in names])


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole document."""
    found = find_secrets(read(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *map(number, kinds),
                        F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
