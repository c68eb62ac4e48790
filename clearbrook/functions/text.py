"""String functions over columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories that title case leaves as they are, and texts that mean nothing.
KEPT_CASE = ["Unknown", "US", "USA", "UK", "UN", "EU"]
NULL_WORDS = ["unknown", "n/a", "na", "none", "tbd", "########", "null", "undefined"]


#: Noncharacters of Unicode, which texts don't hold; one that does has them swapped for the third before it is searched.
MARK, PART, SWAPPED = "\ufdd0", "\ufdd1", "\ufdd2"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, whatever lambdas it is used in."""
    return F.transform(F.array(value), body)[0]


def unmarked(x: Column) -> Column:
    """A text without the marks: they are looked for first, as hardly any text holds one and a translation walks through all its characters."""
    return F.when(x.contains(MARK) | x.contains(PART), F.translate(x, MARK + PART, SWAPPED * 2)).otherwise(x)


def holds_any(low: Column, words: list[str]) -> Column:
    """Whether a text in small letters holds one of some words in small letters, anywhere: a scan of bytes, to spare texts a pattern that can't match without."""
    found = low.contains(words[0])
    for w in words[1:]:
        found = found | low.contains(w)
    return found


def beyond_ascii(x: Column) -> Column:
    return F.octet_length(x) > F.length(x)


def breaks(x: Column) -> Column:
    """Line breaks of a text."""
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def cut_at(x: Column, pattern: str, *groups: int) -> Column:
    """Pieces of a text: what lies between the matches of a pattern and the matches, in turn; groups follow a match after ``PART``. The pattern runs once."""
    marked = F.regexp_replace(unmarked(x), pattern, f"{MARK}$0{''.join(f'{PART}${g}' for g in groups)}{MARK}")
    return F.split(marked, MARK, -1)


def trim_collapse(x: Column) -> Column:
    """White space of any kind, NBSP included, becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def title_case(x: Column) -> Column:
    """The first letter of every run of letters is upper case, the others lower: ``crohn's`` gives ``Crohn'S``."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda r: F.initcap(r)), "")


def category_case(x: Column) -> Column:
    return F.when(x.isin(*KEPT_CASE), x).otherwise(title_case(x))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def email_domain(x: Column) -> Column:
    return F.get(F.split(x, "@"), F.lit(1))


def field_key(x: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def pad_cpt(x: Column) -> Column:
    """Zeros in front up to five characters; longer values stay whole."""
    return F.when(F.length(x) < 5, F.lpad(x, 5, "0")).otherwise(x)


def is_null_word(x: Column) -> Column:
    return F.lower(F.trim(x)).isin(*NULL_WORDS)


def number_of(x: Column) -> Column:
    """The number that a text stands for without ``,``, ``$`` and ``%``; null if it is none."""
    bare = F.trim(F.regexp_replace(x, "[,$%]", ""))
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def expand_words(x: Column, table: dict[str, str]) -> Column:
    """Every word that is in ``table``, in lower case and without ``.,;:!?()`` around it, becomes its long form."""
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    known = lambda w: F.element_at(pairs, F.lower(F.regexp_replace(w, r"^[.,;:!?()]+|[.,;:!?()]+$", "")))
    return F.array_join(F.transform(F.split(x, r"\s+"), lambda w: F.coalesce(known(w), w)), " ")


def fold_replace(x: Column, table: dict[str, str], bounded: bool) -> Column:
    """The text of ``fold_replaced``."""
    return fold_replaced(x, table, bounded)["text"]


def quoted(words: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\/" else c for c in words)


def trie(words: dict[str, str]) -> str:
    """One pattern for many words, each with what must follow it: words that begin alike share that part, so that a text is read once however many there are. Of words that begin at one place the longest is met."""
    root: dict = {}
    for w, after in words.items():
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = after

    def pattern(node: dict) -> str:
        ways = [quoted(ch) + pattern(below) for ch, below in node.items() if ch]
        ways += [node[""]] if "" in node else []
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return pattern(root)


def _unlike(word: str, into: str) -> str:
    """A word must not go on as its replacement does (``parkinson's`` stays)."""
    return f"(?!{quoted(into[len(word) :])})" if into.lower().startswith(word.lower()) and len(into) > len(word) else ""


def _independent(table: dict[str, str]) -> bool:
    """Whether replacing entries in turn is the same as replacing all at once: words that don't meet, and no replacement that holds a later one."""
    words, whole = list(table), re.compile(r"\w(.*\w)?", re.S)
    holds = lambda text, w: re.search(rf"(?i)\b{re.escape(w)}\b{_unlike(w, table[w])}", text)
    return all(whole.fullmatch(w) for w in words) and not any(holds(v, w) for v in words for w in words if v != w) and not any(holds(table[v], w) for i, v in enumerate(words) for w in words[i + 1 :])


def dictionary_replaced(x: Column, table: dict[str, str]) -> Column:
    """struct(text, n): whole words of ``table`` replaced, ignoring case, and how many were, in one pass over the text; entries that depend on each other are replaced in turn."""
    if not _independent(table):
        return fold_replaced(x, table, True)
    words = F.create_map(*[F.lit(v) for kv in table.items() for v in (kv[0].lower(), kv[1])])
    firsts = "".join(sorted({k[0].lower() for k in table}))  # spares the ends of words and what begins like none
    pattern = rf"(?iU)\b(?=[{firsts}])" + trie({k.lower(): r"\b" + _unlike(k, v) for k, v in table.items()})

    def of(pieces: Column) -> Column:
        swapped = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.element_at(words, F.lower(F.upper(p))), p)).otherwise(p))
        return F.struct(F.when(F.size(pieces) == 1, x).otherwise(F.array_join(swapped, "")).alias("text"), F.floor(F.size(pieces) / 2).cast("int").alias("n"))

    return F.when(x.isNull(), F.struct(x.alias("text"), F.lit(0).alias("n"))).otherwise(let(cut_at(x, pattern), of))


def terms_at(x: Column, terms: list[str]) -> Column:
    """array of struct(match, position): at every place where some of ``terms`` begins as whole words, ignoring case, the longest one. One pass over the text; terms may overlap."""
    pattern = rf"(?iU)\b(?=({trie({t.lower(): r'\b' for t in terms})}))"
    marked = F.regexp_replace(unmarked(x), pattern, f"{MARK}$1{PART}")
    none = F.expr("cast(array() as array<struct<match:string,position:int>>)")

    def step(a: Column, piece: Column) -> Column:
        match = F.substring_index(piece, PART, 1)
        found = F.struct(match.alias("match"), a["at"].alias("position"))
        return F.struct((a["at"] + F.length(piece) - F.length(match) - 1).alias("at"), F.concat(a["out"], F.array(found)).alias("out"))

    def of(pieces: Column) -> Column:
        start = F.struct(F.length(pieces[0]).alias("at"), none.alias("out"))
        return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step, lambda a: a["out"])

    return F.coalesce(let(F.split(marked, MARK, -1), of), none)


def fold_replaced(x: Column, table: dict[str, str], bounded: bool) -> Column:
    """struct(text, n): entries of ``table`` replaced one after the other, ignoring case, and how many were; ``bounded``: whole words only, and none that goes on as its replacement does (``parkinson's`` stays). Texts that hold none are left alone."""
    mark = lambda k, v: rf"(?iU)\b{quoted(k)}\b{_unlike(k, v)}" if bounded else f"(?i){quoted(k)}"
    steps = F.array(*[F.struct(F.lit(mark(k, v)).alias("p"), F.lit(v.replace("$", r"\$")).alias("v")) for k, v in table.items()])
    some = f"(?iU){'\\b' if bounded else ''}(?:{'|'.join(quoted(k) for k in table)}){'\\b' if bounded else ''}"
    step = lambda a, s: let(F.regexp_count(a["text"], s["p"]), lambda n: F.when(n == 0, a).otherwise(F.struct(F.regexp_replace(a["text"], s["p"], s["v"]).alias("text"), (a["n"] + n).alias("n"))))
    start = F.struct(x.alias("text"), F.lit(0).alias("n"))
    return F.when(x.rlike(some), F.aggregate(steps, start, step)).otherwise(start)


def guard_formula(x: Column) -> Column:
    """A quote before texts that a spreadsheet would run."""
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)
