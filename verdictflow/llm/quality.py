"""Quality rules, line first: every line is judged on its own, failing lines are removed, and a
document that loses too much of its text is rejected.

Defined results: a null text counts as having no words (all measures 0, base_failed, not kept); an
empty table gives an empty table; repeated rows and repeated ids are judged row by row; extra
columns of the input are passed by `clean` and ignored by `judge`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, texts_of, words_of

SYMBOLS = "#*$%&|<>"
#: Phrases of site furniture; a short line that has one is boilerplate.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "forgot your password", "log in to",
    "next page", "previous page", "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to our", "terms of service", "terms of use",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds, all as whole percentages so that integer SQL gives the same verdicts.

    bang_pct: words ending in two or more exclamation or question marks, of the line's words
    symbol_pct: characters of SYMBOLS, against the line's words
    menu_bars: vertical bars that make a line a menu, when they also are bar_pct of the words
    echo_pct: words equal to the word before them
    boilerplate_words: longest line that a boilerplate phrase condemns
    stub_words: a line of fewer words, without a letter or digit, is furniture
    lost_pct: characters of words in failing lines, of all word characters, that reject a document
    """

    bang_pct: int = 30
    symbol_pct: int = 50
    menu_bars: int = 3
    bar_pct: int = 10
    echo_pct: int = 50
    echo_words: int = 4
    boilerplate_words: int = 12
    lost_pct: int = 30
    min_words: int = 50
    repeat_pct: int = 50


RULES = LineRules()
_BANGS = re.compile("[!?]{2,}(?=[\x20\x09-\x0d]|\\Z)")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)))
_UPPER = {c: c + 32 for c in range(65, 91)}


def line_fails(line: str, words: list[str], rules: LineRules = RULES) -> str | None:
    """The rule that a line with words fails: punctuation, navigation, boilerplate, or None."""
    n = len(words)
    if ("!" in line or "?" in line) and 100 * len(_BANGS.findall(line)) > rules.bang_pct * n:
        return "punctuation"
    if 100 * sum(map(line.count, SYMBOLS)) > rules.symbol_pct * n:
        return "punctuation"
    bars = line.count("|")
    if bars >= rules.menu_bars and 100 * bars > rules.bar_pct * n:
        return "navigation"
    if n >= rules.echo_words and 100 * sum(map(str.__eq__, words, words[1:])) > rules.echo_pct * n:
        return "navigation"
    if n <= rules.boilerplate_words and _BOILER.search(line.translate(_UPPER)):
        return "boilerplate"
    return None


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that the text has at least twice, first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def judge_text(text: str | None, rules: LineRules = RULES) -> dict:
    """All measures of one text, and the text without its failing lines."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    seen: set[str] = set()
    dup = lost = bad = 0
    stay: list[str] = []
    for line in text.split("\n"):
        own = words_of(line)
        if own:
            dup += line in seen
            seen.add(line)
            if line_fails(line, own, rules):
                lost += sum(map(len, own))
                bad += 1
                continue
        stay.append(line)
    chars, repeats = sum(map(len, words)), repeated_words(words)
    failed = n < rules.min_words or 100 * repeats > rules.repeat_pct * n
    return {
        "n_words": n, "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup, "n_repeat_words": repeats, "base_failed": failed,
        "kept": not failed and 100 * lost <= rules.lost_pct * chars, "n_bad_lines": bad, "lost_chars": lost, "clean_text": "\n".join(stay) if bad else text,
    }


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bad_lines long, lost_chars long"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = RULES) -> DataFrame:
    """One row per document: its id, the measures and the verdict. A narrow map, no shuffle."""
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def make():
        def step(batch):
            found = [judge_text(t, rules) for t in texts_of(batch)]
            yield {"doc_id": batch.column("doc_id")} | {k: [x[k] for x in found] for k in names}

        return step

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), f"doc_id {kind}, {FIELDS}", make)


def clean(docs: DataFrame, text_col: str = "text", rules: LineRules = RULES) -> DataFrame:
    """The documents that pass, with failing lines removed and n_chars (if there) set anew; the
    columns are those of docs, in their order."""
    names = docs.columns

    def make():
        def step(batch):
            found = [judge_text(t, rules) for t in texts_of(batch, "t")]
            yield {"row": batch.column("row"), "t": [x["clean_text"] for x in found], "kept": [x["kept"] for x in found], "changed": [x["n_bad_lines"] > 0 for x in found]}

        return step

    rest = [c for c in names if c != text_col]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("t"))
    judged = arrow_map(row, f"row {row.schema['row'].dataType.simpleString()}, t string, kept boolean, changed boolean", make).filter("kept")

    def column(c: str):
        if c == text_col:
            return F.col("t").alias(c)
        own = F.col("row").getField(c)
        return (F.when(F.col("changed"), F.length("t").cast(dict(docs.dtypes)[c])).otherwise(own) if c == "n_chars" else own).alias(c)

    return judged.select(*map(column, names))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same measures and line rules in DuckDB."""
    w = r"[^\x20\x09-\x0D]+"
    r = RULES
    symbols = lambda x: " + ".join(f"(length({x}) - length(replace({x}, '{c}', '')))" for c in SYMBOLS)
    boiler = "|".join(x.replace(" ", r"\x20") for x in BOILERPLATE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{w}') AS ws FROM d),
tri AS (SELECT r, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, k, ls[k] AS line FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d))),
lw AS (SELECT r, k, line, regexp_extract_all(line, '{w}') AS ws FROM ln),
lf AS (SELECT r, k, line, len(ws) AS n, list_sum(list_transform(ws, lambda x: length(x))) AS chars,
  len(regexp_extract_all(line, '[!?]{{2,}}(?:[\\x20\\x09-\\x0D]|\\z)')) AS bangs, {symbols("line")} AS syms, length(line) - length(replace(line, '|', '')) AS bars,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS echo,
  regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{boiler}') AS boiler,
  row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS dup FROM lw WHERE len(ws) > 0),
lv AS (SELECT *, 100 * bangs > {r.bang_pct} * n OR 100 * syms > {r.symbol_pct} * n OR (bars >= {r.menu_bars} AND 100 * bars > {r.bar_pct} * n)
  OR (n >= {r.echo_words} AND 100 * echo > {r.echo_pct} * n) OR (n <= {r.boilerplate_words} AND boiler) AS bad FROM lf),
la AS (SELECT r, sum(chars) AS word_chars, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(chars) FILTER (bad), 0) AS lost_chars FROM lv GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST({symbols("text")} AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_bad_lines, 0) AS BIGINT) AS n_bad_lines, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN la USING (r)),
v AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.repeat_pct} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {r.lost_pct} * word_chars AS kept, n_bad_lines, lost_chars FROM v"""


SQL = _sql()
