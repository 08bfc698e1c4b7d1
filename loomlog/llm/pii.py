"""Personal data by weak supervision. DataFrame functions on the data; the models' tables are bounded.

Fixed base kinds (email, ip, card, phone) are found by pattern and check. Candidates of further kinds are
voted on by labelers: regular expressions, gazetteers of cue words, and the context around the span.
Each says yes (1), no (0) or nothing (-1). The candidates are counted by kind and votes, a table of at most
4 * 3 ** 6 * 3 rows. Expectation-maximisation over it estimates how reliable each labeler is, and the
posteriors train the final span classifier, a logistic regression that becomes one SQL expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import write_table

#: The base kinds in order. Starts are held to run starts or the last match's end, and repeats are possessive:
#: the matches are the leftmost ones of the plain patterns, found in linear time and without deep recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a base kind to be looked for.
GUARD = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9][\x20().0-9-]",
}
#: A value of six characters or more, some of them no letters, that a word for a secret is set to.
_ASSIGNED = (
    r"(?<=[:=\x20\"'])(?<=(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']{0,1}\x20{0,2}[:=]\x20{0,2}[\"']{0,1})"
    r"(?=[A-Za-z]{0,64}[0-9!@#$%^&*_+?-])[^\x20\x09-\x0D\"'<>,;]{6,64}+"
)
#: Candidates of the kinds that the votes decide on.
EXTRA = {
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+(?!@)|" + _ASSIGNED,
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+().-])(?<!\+[0-9]{1,3}[\x20.-]{0,2})\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
KINDS = [*BASE, *EXTRA]
CUES = {
    "secret": "token|secret|key|api|apikey|password|passwd|pwd|credential|bearer|auth",
    "ssn": "ssn|social|security|taxpayer|insurance",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "local_phone": "phone|tel|telephone|call|mobile|cell|fax|contact",
}
NEGATIVE_CUES = "isbn|issn|doi|version|commit|sha1|sha256|md5|checksum|hash|build|page|figure|table|serial|order|part"
LABELERS = ("format", "mixture", "cue", "negative_cue", "assigned", "embedded")
BEFORE, AFTER = 40, 8


def _matches(text: Column, kind: str, pattern: str, guard: str) -> Column:
    """Array of (kind, i, match, gap, before, after): matches in order and what stands between them."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    item = lambda m, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), m.alias("match"), F.length(F.element_at(gaps, i + 1)).cast("long").alias("gap"),
        F.right(F.element_at(gaps, i + 1), F.lit(BEFORE)).alias("before"), F.left(F.element_at(gaps, i + 2), F.lit(AFTER)).alias("after"),
    )
    none = F.array().cast("array<struct<kind:int,i:int,match:string,gap:bigint,before:string,after:string>>")
    return F.when(text.rlike(guard), F.transform(found, item)).otherwise(none)


def _luhn(digits: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    """The base kinds' checks; candidates of other kinds pass."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    part = lambda x: F.regexp_replace(x, "^0+", "")
    small = F.forall(F.split(match, r"\.", -1), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))
    card = F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.when(kind == KINDS.index("ip"), small).when(kind == KINDS.index("card"), card).when(
        kind == KINDS.index("phone"), F.length(digits).between(8, 15)
    ).otherwise(True)


def _votes(kind: Column, match: Column, before: Column, after: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 yes, 0 no, -1 nothing."""
    low = F.lower(before)
    letters, digits = match.rlike("[A-Za-z]"), match.rlike("[0-9]")
    is_kind = {k: kind == KINDS.index(k) for k in EXTRA}
    strict = F.when(is_kind["secret"], match.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|gh[a-z]|xox[a-z])[-_][A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16})$"))
    strict = strict.when(is_kind["ssn"], ~match.rlike("^(?:000|666|9)|-00-|0000$")).when(is_kind["iban"], F.length(F.replace(match, F.lit(" "))).between(15, 34))
    strict = strict.otherwise(match.rlike(r"^\(?[2-9][0-9]{2}"))
    mixed = F.when(is_kind["secret"], F.when(letters & digits, 1).otherwise(0)).when(is_kind["iban"], F.when(match.rlike("[0-9]{6}"), 1).otherwise(0)).otherwise(-1)
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | (is_kind[k] & low.rlike(rf"(?<![a-z])(?:{words})s?(?![a-z])"))
    return {
        "format": F.when(strict, 1).when(is_kind["secret"], -1).otherwise(0),
        "mixture": mixed,
        "cue": F.when(cue, 1).otherwise(-1),
        "negative_cue": F.when(low.rlike(rf"(?<![a-z])(?:{NEGATIVE_CUES})s?(?![a-z])"), 0).otherwise(-1),
        "assigned": F.when(before.rlike("[=:]\\x20?[\"']?$") | (before.rlike("[\"'`(]$") & after.rlike("^[\"'`)]")), 1).otherwise(-1),
        "embedded": F.when(before.rlike(r"[/?&#.@\\]$") | after.rlike(r"^[./\\@][A-Za-z]"), 0).otherwise(-1),
    }


def em(counts: np.ndarray, votes: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each vote pattern, reliability [labeler, class, vote + 1], prior) by expectation-maximisation.

    Starts from the majority of the votes; ties count as half. Smoothed by one vote each.
    """
    yes, no = (votes == 1).sum(1), (votes == 0).sum(1)
    post = np.where(yes + no > 0, (yes + 0.5) / (yes + no + 1.0), 0.5)
    table, prior = np.full((votes.shape[1], 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        for v in range(3):
            table[:, :, v] = ((votes == v - 1).T @ weight.T) + 1
        table /= table.sum(2, keepdims=True)
        log = np.log([1 - prior, prior]) + sum(np.log(table[j][:, votes[:, j] + 1]).T for j in range(votes.shape[1]))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
    return post, table, prior


def span_features(kinds: np.ndarray, votes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """One-hot kinds, votes (yes and no) and length classes, and a constant."""
    hot = [kinds[:, None] == np.arange(len(BASE), len(KINDS)), votes == 1, votes == 0, length[:, None] == np.arange(3)]
    return np.column_stack([*(x.astype(float) for x in hot), np.ones(len(kinds))])


def train(x: np.ndarray, post: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    scale = counts / max(counts.mean(), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (scale * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (scale * (post - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _length_class(match: Column) -> Column:
    return F.when(F.length(match) < 30, 0).when(F.length(match) <= 64, 1).otherwise(2)


def _score(w: Sequence[float]) -> Column:
    """The classifier's margin as a column."""
    terms = [F.when(F.col("kind") == k, float(w[k - len(BASE)])).otherwise(0.0) for k in range(len(BASE), len(KINDS))]
    at, n = len(EXTRA), len(LABELERS)
    for j, name in enumerate(LABELERS):
        terms.append(F.when(F.col(name) == 1, float(w[at + j])).when(F.col(name) == 0, float(w[at + n + j])).otherwise(0.0))
    at += 2 * n
    terms.append(F.element_at(F.array(*(F.lit(float(w[at + c])) for c in range(3))), F.col("length_class") + 1))
    total = F.lit(float(w[-1]))
    for t in terms:
        total = total + t
    return total


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (array of kind, start, end, base, in the order of KINDS and start), row (a hash of the text).

    Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows get
    equal spans; null ids are ids like any other. Other columns are ignored. Without candidates of the voted kinds there
    is nothing to train on and only base spans are found.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [_matches(text, k, p, GUARD[k]) for k, p in BASE.items()] + [_matches(text, k, p, p) for k, p in EXTRA.items()]
    rows = write_table(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"), F.concat(*found).alias("found")), "pii-candidates")

    spans = rows.filter(F.size("found") > 0).select("doc_id", "row", F.explode("found").alias("m")).select("doc_id", "row", "m.*")
    spans = spans.repartition("doc_id", "row").dropDuplicates(["doc_id", "row", "kind", "i"])
    upto = W.partitionBy("doc_id", "row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = spans.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto)).withColumn("start", F.col("end") - F.length("match"))
    spans = spans.filter(_holds(F.col("kind"), F.col("match")))
    spans = spans.withColumns(_votes(F.col("kind"), F.col("match"), F.col("before"), F.col("after"))).withColumn("length_class", _length_class(F.col("match")))
    spans = write_table(spans.select("doc_id", "row", "kind", "start", "end", *LABELERS, "length_class"), "pii-spans")

    is_base = F.col("kind") < len(BASE)
    patterns = spans.filter(~is_base).groupBy("kind", *LABELERS, "length_class").count().collect()  # bounded by the votes' combinations
    good = is_base
    if patterns:
        p = np.array([tuple(r) for r in patterns], dtype=np.int64)
        kinds, votes, length, counts = p[:, 0], p[:, 1:-2], p[:, -2], p[:, -1].astype(float)
        post, _, _ = em(counts, votes)
        w = train(span_features(kinds, votes, length), post, counts)
        good = is_base | (_score([float(f"{x:.9g}") for x in w]) >= 0)
    kept = spans.filter(good).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    kept = kept.select(F.col("doc_id").alias("__ll_id"), F.col("row").alias("__ll_row"), "spans")
    out = rows.select("doc_id", "row").join(kept, F.col("doc_id").eqNullSafe(F.col("__ll_id")) & (F.col("row") == F.col("__ll_row")), "left")
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(
        F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")),
        lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["kind"] < len(BASE)).alias("base")),
    )
    return out.select("doc_id", named.alias("spans"), "row")


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text) and n_spans (of all kinds) of ``find_pii``'s rows."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(said(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by <KIND>; of overlapping spans the earlier one, then the longer one.

    ``found`` comes from ``find_pii`` over the same rows. Spans belong to an id (which may be null) and a text, so repeated rows are
    redacted each, and rows come out as often as they go in. Null texts stay null.
    """
    def cover(s: Column, x: Column) -> Column:
        fits = x["start"] >= s["at"]
        piece = F.concat(F.substring(F.col(text_col), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.struct(F.when(fits, x["end"]).otherwise(s["at"]).alias("at"), F.when(fits, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    order = F.array_sort(F.transform("__ll_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    new = F.aggregate(order, start, cover, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col(text_col), (s["at"] + 1).cast("int"), F.length(text_col))))
    known = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("__ll_id"), F.col("row").alias("__ll_row"), F.col("spans").alias("__ll_spans")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__ll_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__ll_row"))
    joined = docs.join(known, same, "left")
    return joined.select(*[(F.when(F.size("__ll_spans") > 0, new).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c)) for c in docs.columns])
