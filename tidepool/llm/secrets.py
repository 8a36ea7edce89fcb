"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regex gives a Boolean query over trigrams that every match must contain (in disjunctive form: any
of several sets; of a mandatory string the trigrams that cover it, not all that overlap). The index holds postings (trigram, text key) of the trigrams that the queries name, over
lower-cased texts. Posting lists are intersected by counting, per clause and key, the clause's trigrams; keys
that satisfy a clause are the rule's candidates, and only their texts are searched with the regex. Rules
without a mandatory trigram are searched in every text.

A key is the 64-bit hash of the text, so copies share their postings; were different texts to share a key, the
key has the postings of them all and all are searched, so no match is lost.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.shared import inline_table, table, written


@dataclass(frozen=True)
class Rule:
    """regex: a Java regex; of each match, group `measured` (0: all of it) must have `least` characters.

    sql: the regex for engines without possessive quantifiers, where it differs.
    """

    name: str
    regex: str
    measured: int = 0
    least: int = 1
    sql: str = ""


#: The kinds whose spans the query's contract fixes, in the order it lists them.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),  # as a whole run of 16 or more: a run can only fail as a whole
    Rule("hex", r"[0-9a-f]{32,}"),
)
_PEM = r"[A-Z ]{0,20}PRIVATE KEY[A-Z ]{0,20}-----"
#: A whole block up to its END; where none follows, the header with the lines of base64 after it. Line ends may be
#: escaped. Possessive, since Java's other loops over groups would overflow the stack on long bodies.
_PRIVATE_KEY = rf"-----BEGIN {_PEM}(?:[^-]*+(?:-{{1,4}}[^-]++)*+-----END {_PEM}|(?:(?:[ \t\r\n]|\\[nr])++[A-Za-z0-9+/=]{{40,}}+)*+)"
#: Public formats of credentials, added to the base kinds.
MORE_RULES = (
    Rule("private_key", _PRIVATE_KEY, sql=re.sub(r"([*+}])\+", r"\1", _PRIVATE_KEY)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("sk_key", r"\bsk-[A-Za-z0-9_-]{20,}"),
)
_MOST_STRINGS, _MOST_CHOICES = 64, 8
_BLOCK = 512


def parse(regex: str) -> list:
    """A regex as branches of sequences of nodes: ("set", characters or None for too many), ("group", branches),
    ("repeat", least, most, node) and ("empty",) for what takes no characters. Lookarounds count as empty.
    """
    at = 0
    single = {"n": "\n", "r": "\r", "t": "\t", "f": "\f"}

    def taken(*options: str) -> str:
        nonlocal at
        for o in options:
            if regex.startswith(o, at):
                at += len(o)
                return o
        return ""

    def upto(mark: str) -> str:
        nonlocal at
        start, at = at, regex.index(mark, at) + len(mark)
        return regex[start : at - len(mark)]

    def one() -> str:
        nonlocal at
        at += 1
        return regex[at - 1]

    def escape() -> str | None:
        """The character, "" for an assertion, None for a class."""
        nonlocal at
        c = one()
        if c in "pP" and taken("{"):
            upto("}")
        if c == "x":
            at += 2
            return chr(int(regex[at - 2 : at], 16))
        return "" if c in "bBAzZG" else None if c in "dDwWsSpPhHvV" else single.get(c, c)

    def bracket() -> set[str] | None:
        negated, out, first = bool(taken("^")), set(), True
        while first or not regex.startswith("]", at):
            first, c = False, one()
            low = escape() if c == "\\" else c
            if regex.startswith("-", at) and not regex.startswith("-]", at):
                one()
                c = one()
                high = escape() if c == "\\" else c
                out = None if out is None or ord(high) - ord(low) >= _MOST_CHOICES else out | {chr(x) for x in range(ord(low), ord(high) + 1)}
            else:
                out = None if out is None or low is None else out | {low}
        one()
        return None if negated or out is None or len(out) > _MOST_CHOICES else out

    def atom():
        c = one()
        if c == "(":
            look = taken("?=", "?!", "?<=", "?<!")
            if not look and taken("?<"):
                upto(">")
            elif not look and not taken("?:", "?>") and taken("?"):
                while one() not in ":)":
                    pass
                if regex[at - 1] == ")":
                    return ("empty",)
            inner = branches()
            one()
            return ("empty",) if look else ("group", inner)
        if c == "[":
            return ("set", bracket())
        if c in "^$":
            return ("empty",)
        known = escape() if c == "\\" else None if c == "." else c
        return ("empty",) if known == "" else ("set", None if known is None else {known})

    def branches() -> list:
        out = [[]]
        while at < len(regex) and regex[at] != ")":
            if taken("|"):
                out.append([])
                continue
            node = atom()
            while sign := taken("*", "+", "?", "{"):
                low, comma, high = upto("}").partition(",") if sign == "{" else {"*": "0", "+": "1", "?": "0,1"}[sign].partition(",")
                node = ("repeat", int(low), int(high) if high else int(low) if sign == "{" and not comma else None, node)
                taken("+", "?")
            out[-1].append(node)
        return out

    return branches()


def _cover(s: str) -> frozenset[str]:
    """Trigrams that together hold every character of a string of three or more."""
    return frozenset(s[i : i + 3] for i in {*range(0, len(s) - 2, 3), len(s) - 3} if i >= 0)


def trigram_query(regex: str) -> frozenset[frozenset[str]] | None:
    """Sets of lower-case trigrams; every match contains all trigrams of one of them. None: no mandatory trigram."""
    def strings_of(sequence: list) -> set[str] | None:
        """All strings that a small part matches, lower-cased; None if they are too many."""
        out = {""}
        for kind, *arg in sequence:
            if kind == "set":
                own = None if arg[0] is None else {c.lower() for c in arg[0]}
            elif kind == "group":
                parts = [strings_of(b) for b in arg[0]]
                own = None if None in parts else set().union(*parts)
            elif kind == "repeat" and arg[1] is not None and arg[1] <= _MOST_CHOICES:
                own = strings_of([arg[2]])
                own = None if own is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(own, repeat=n)} if len(own) ** arg[1] <= _MOST_STRINGS else None
            else:
                own = {""} if kind == "empty" else None
            if own is None or len(out) * len(own) > _MOST_STRINGS:
                return None
            out = {a + b for a in out for b in own}
        return out

    def clauses_of(sequence: list) -> set[frozenset[str]]:
        clauses = [frozenset()]  # a conjunction so far, for each alternative
        strings = {""}  # what the current unbroken run can be

        def require(options: set[frozenset[str]]) -> None:
            nonlocal clauses
            if len(options) * len(clauses) <= _MOST_STRINGS:
                clauses = [c | o for c in clauses for o in options]

        for node in [*spelled(sequence), None]:
            choices = strings_of([node]) if node else None
            if choices == {""}:
                continue
            if choices and "" not in choices and len(grown := {s + c for s in strings for c in choices}) <= _MOST_STRINGS:
                strings = grown
                continue
            require({*map(_cover, strings)})  # what may be left out, or is unknown, ends the run
            strings = choices if choices and "" not in choices else {""}
            if node and not choices and node[0] == "group":
                require(set().union(*map(clauses_of, node[1])))
        return set(clauses)

    def spelled(sequence: list):
        """Unbounded repeats as so many mandatory nodes and a rest that may be left out."""
        for node in sequence:
            if node[0] == "repeat" and strings_of([node]) is None:
                yield from [node[3]] * min(node[1], _MOST_CHOICES)
                node = ("repeat", 0, None, node[3])
            yield node

    clauses = clauses_of([("group", parse(regex))])
    least = {c for c in clauses if not any(o < c for o in clauses)}
    return None if frozenset() in least else frozenset(least)


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def trigram_index(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """Postings (trigram, key) of the given trigrams over lower-cased texts, each once."""
    grams = F.array(*map(F.lit, sorted(trigrams)))
    # the outer lambda keeps the lower-cased text, which would else be made again for each trigram
    present = F.transform(F.array(F.lower(F.col(text))), lambda low: F.filter(grams, lambda t: F.contains(low, t)))[0]
    distinct = docs.select(text_key(text).alias("key"), present.alias("_grams")).where(F.size("_grams") > 0)
    # one row for each key before postings are spelled out; a key has several arrays only if texts share its hash
    grouped = distinct.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("_grams"))).alias("_grams"))
    return grouped.select(F.explode("_grams").alias("trigram"), "key")


def candidates(index: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """(key, rules): the rules with a clause all of whose trigrams have the key in their postings."""
    rows = [
        {"trigram": t, "rule": name, "clause": i, "needed": len(clause)}
        for name, clauses in queries.items() for i, clause in enumerate(sorted(clauses, key=sorted)) for t in sorted(clause)
    ]
    clauses = inline_table(index.sparkSession, rows, "trigram string, rule string, clause int, needed int")
    met = index.join(F.broadcast(clauses), "trigram").groupBy("key", "rule", "clause").agg(
        F.count("*").alias("n"), F.first("needed").alias("needed")
    )
    return met.where("n = needed").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, kind order, end, kind>>, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.measured)) if rule.measured else found
    gaps = F.split(text, rule.regex, -1)
    # walks over gap, match, gap, match, ...: a gap moves the position, a match is recorded and moves it too
    steps = F.zip_with(
        F.transform(F.slice(gaps, F.lit(1), F.size(found)), lambda g: F.char_length(g)),
        F.zip_with(found, measured, lambda m, g: F.struct(F.char_length(m).alias("n"), F.char_length(g).alias("g"))),
        lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["g"].alias("g")),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")

    def step(acc, s):
        start = acc["at"] + s["gap"]
        end = start + s["n"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), F.lit(rule.name).alias("name"))
        spans = F.when(s["g"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def walk(block, base):
        return F.aggregate(block, F.struct(base.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    def place(all_steps):
        """In blocks, since growing one array match by match would cost the square of the matches."""
        count = F.ceil(F.size(all_steps) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(all_steps, i * _BLOCK + 1, F.lit(_BLOCK)))
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, s: n + s["gap"] + s["n"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases"))
        bases = F.aggregate(sizes, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")), lambda acc: acc["bases"])
        return F.flatten(F.zip_with(blocks, bases, walk))

    # the outer lambda keeps the matches, which would else be searched again for each block
    placed = F.transform(F.array(steps), place)[0]
    return F.when(F.rlike(text, F.lit(rule.regex)), placed).otherwise(none)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text") -> DataFrame:
    """docs with secrets: array<struct<start, kind, end, name>>, ordered by start, then by the order of rules.

    Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are scanned each
    for itself. Columns of docs named secrets, or beginning with _secret_, are replaced; all others, whatever their
    names, are kept. No rows in, no rows out.
    """
    queries = {r.name: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    content = F.coalesce(F.col(text), F.lit(""))
    named = [(i, r) for i, r in enumerate(rules) if r.name in indexed]
    grams = sorted({t for q in indexed.values() for c in q for t in c})
    hits = written(candidates(trigram_index(docs, grams, text), indexed), "secret-candidates").toDF("_secret_key", "_secret_rules")
    own = [c for c in docs.columns if c.lower() != "secrets" and not c.lower().startswith("_secret_")]
    # rules without a query are searched before the join, where each text is read
    full = F.concat(*[spans_of(r, i, content) for i, r in enumerate(rules) if r.name not in indexed])
    out = docs.select(*own, text_key(text).alias("_secret_key"), full.alias("_secret_full")).join(hits, "_secret_key", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")
    verified = [F.when(F.array_contains("_secret_rules", r.name), spans_of(r, i, content)).otherwise(none) for i, r in named]
    found = F.when(F.col("_secret_rules").isNull(), F.col("_secret_full")).otherwise(F.concat("_secret_full", *verified))
    return out.select(*own, F.array_sort(found).alias("secrets"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def op6_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["name"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(r.name) for r in BASE_RULES],
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", spans: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by mark; overlapping spans are one. Other texts stay as they are."""
    content = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        before = F.substring(content, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(content, acc["at"] + 1, F.char_length(content)))
    redacted = F.aggregate(spans, start, step, rest)
    return docs.withColumn(text, F.when(F.size(spans) > 0, redacted).otherwise(content))


def _sql() -> str:
    """The same for DuckDB: gaps and matches of each rule in turn, matches placed by the lengths before them."""
    rules = BASE_RULES + MORE_RULES
    parts, spans = [], []
    for i, r in enumerate(rules):
        rx = (r.sql or r.regex).replace("'", "''")
        parts.append(f"regexp_extract_all(t, '{rx}') AS m{i}, regexp_extract_all(t, '{rx}', {r.measured}) AS g{i}, string_split_regex(t, '{rx}') AS s{i}")
        start = f"(list_sum(list_transform(s{i}[:j], lambda y: length(y))) + coalesce(list_sum(list_transform(m{i}[:j-1], lambda y: length(y))), 0))::BIGINT"
        spans.append(
            f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda j: length(g{i}[j]) >= {r.least}), "
            f"lambda j: {{'at': {start}, 'kind': {i}, 'until': {start} + length(m{i}[j]), 'name': '{r.name}'}})")
    text = "array_to_string(list_transform({}, lambda x: concat(x.name, ':', x.at, ':', x.until)), ',')"
    base = f"list_filter(s, lambda x: x.kind < {len(BASE_RULES)})"
    counts = ", ".join(f"len(list_filter(s, lambda x: x.name = '{r.name}')) AS n_{r.name}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, {', '.join(parts)} FROM d),
  q AS (SELECT doc_id, list_sort({' || '.join(spans)}) AS s FROM p)
  SELECT doc_id, {counts}, sha256({text.format(base)}) AS base_sha256, {text.format('s')} AS spans FROM q"""


SQL = _sql()
