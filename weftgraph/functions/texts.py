"""Column functions over source text, claims and search fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A figure that stands alone, weights of match tiers, and the separators that begin a word.
FIGURE = r"(?<![\w./-])\d{1,3}(?:,\d{3})+(?![\w/-])|(?<![\w./-])\d+(?:\.\d+)?(?![\w/-])"
EXACT, PREFIX, BOUNDARY, SUBSEQUENCE, CONTEXT_PENALTY = 1000, 800, 600, 400, 150
DYNAMIC_JS = r"""\b(?:import|require)\s*\(\s*(?!(?:"[^"\n]*"|'[^'\n]*'|`[^`$\n]*`)\s*[,)])"""
DYNAMIC_PY = r"""\b(?:import_module|__import__)\s*\(\s*[^\s"')]"""
PY_MAIN_GUARD = r"""(?m)^if\s+__name__\s*==\s*["']__main__["']\s*:"""
GO_PACKAGE_MAIN = r"(?m)^package\s+main\b"


def line_count(text: Column) -> Column:
    """Line breaks plus one; a final break counts a line more."""
    return F.size(F.split(text, r"\r?\n", -1))


def figures(text: Column) -> Column:
    """Numbers that stand alone in a text, without the commas between their thousands."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({FIGURE})"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")))


def literal_pattern(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/" else c for c in text)


def tier(field: Column, query: str) -> Column:
    """The best of exact, prefix, at a word's beginning, and in order somewhere; null for none of them."""
    q = query.lower()
    at = literal_pattern(q)
    anywhere = ".*".join(literal_pattern(c) for c in q)
    # a word begins after a separator, or where an upper-case letter follows a lower-case one
    head, rest = q[:1], q[1:]
    camel = rf"[\p{{Ll}}]{literal_pattern(head.upper())}(?i:{literal_pattern(rest)})" if head.upper() != head else rf"[\p{{Ll}}]{at}"
    return (
        F.when(F.lower(field) == q, EXACT)
        .when(F.lower(field).startswith(q), PREFIX)
        .when(F.lower(field).rlike(rf"[/\-_.@: ]{at}") | field.rlike(camel), BOUNDARY)
        .when(F.lower(field).rlike(f"(?s){anywhere}"), SUBSEQUENCE)
    )


def score(label: Column, context: Column, query: str) -> Column:
    """A label's tier; if the label doesn't match, the context's with a penalty."""
    return F.coalesce(tier(label, query), tier(context, query) - F.lit(CONTEXT_PENALTY))


def matched_indices(text: str, query: str) -> list[int] | None:
    """Places of the characters that the best tier matches, for highlighting."""
    low, q = text.lower(), query.lower()
    if low.startswith(q):
        return list(range(len(q)))
    at = low.find(q)
    while at >= 0:
        before = text[at - 1]
        if before in "/-_.@: " or (before.islower() and text[at] == text[at].upper()):
            return list(range(at, at + len(q)))
        at = low.find(q, at + 1)
    out, i = [], 0
    for c in q:
        i = low.find(c, i)
        if i < 0:
            return None
        out.append(i)
        i += 1
    return out


def segments_of(text: str, indices: list[int]) -> list[tuple[str, bool]]:
    """Runs of matched and unmatched characters."""
    hit, out = set(indices), []
    for i, c in enumerate(text):
        on = i in hit
        if out and out[-1][1] == on:
            out[-1] = (out[-1][0] + c, on)
        else:
            out.append((c, on))
    return out
