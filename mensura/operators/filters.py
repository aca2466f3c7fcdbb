"""Filters and projections (FL1-FL9, SC14-SC16).

All are narrow transformations (no shuffle); predicates on scan columns are
pushed into the parquet reader by Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """FL1: keep rows where ``col == value``."""
    return df.filter(F.col(col) == F.lit(value))


def drop_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """FL2: drop rows with any null (in ``subset`` if given)."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """FL3: drop rows where every column is null."""
    return df.na.drop("all")


_UNNAMED = re.compile(r"^(_c\d+|Unnamed: ?\d+|)$")


def unnamed_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if _UNNAMED.match(c)]


def drop_unnamed(df: DataFrame) -> DataFrame:
    """FL4: drop columns with blank headers (Spark names them ``_cN``)."""
    return df.drop(*unnamed_columns(df))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FL5: fill nulls with 0 in the listed columns that exist."""
    present = [c for c in cols if c in df.columns]
    return df.na.fill(0, present) if present else df


def exclude_periods(df: DataFrame, months: Sequence[str], order: str = "period") -> DataFrame:
    """FL6: drop rows whose ``yyyy-MM`` is in ``months``."""
    return df.filter(~F.date_format(order, "yyyy-MM").isin(list(months)))


def non_empty(df: DataFrame, text: str = "title", ts: str = "created_utc") -> DataFrame:
    """FL7: keep rows with a non-empty text and a timestamp."""
    return df.filter((F.length(F.trim(F.col(text))) > 0) & F.col(ts).isNotNull())


_NONWORD = r"[^\p{L}\p{N}_]"


def word_pattern(words: Sequence[str]) -> str:
    """Regex matching any of ``words`` as a whole word. Word boundaries are
    spelled as Unicode letter/digit classes so accented text splits the same
    way in every regex engine."""
    alt = "|".join(re.escape(w.lower()) for w in words)
    return f"(^|{_NONWORD})({alt})($|{_NONWORD})"


def keyword_predicate(text: str, all_of: Sequence[str] = (), any_of: Sequence[str] = ()) -> Column:
    """Whole-word, case-insensitive keyword predicate: every word of
    ``all_of`` and at least one of ``any_of``."""
    low = F.lower(F.col(text))
    cond = F.lit(True)
    for w in all_of:
        cond = cond & low.rlike(word_pattern([w]))
    if any_of:
        cond = cond & low.rlike(word_pattern(any_of))
    return cond


def keyword_filter(df: DataFrame, text: str, all_of=(), any_of=(), ts: str | None = None,
                   after=None, before=None) -> DataFrame:
    """FL8: keyword predicate plus a ``[after, before)`` time range. The range
    is a plain comparison, so it is pushed to the scan when ``ts`` is a
    source column."""
    cond = keyword_predicate(text, all_of, any_of)
    if ts is not None and after is not None:
        cond = cond & (F.col(ts) >= F.lit(after))
    if ts is not None and before is not None:
        cond = cond & (F.col(ts) < F.lit(before))
    return df.filter(cond)


def bbox_filter(df: DataFrame, box: Sequence[float], tag: str = "shop",
                types: Sequence[str] = ("node", "way", "relation"), lon="lon", lat="lat",
                tags="tags", kind="osm_type") -> DataFrame:
    """FL9: objects inside ``(min_lon, min_lat, max_lon, max_lat)`` that carry
    ``tag`` and are of one of ``types``."""
    x0, y0, x1, y1 = box
    return df.filter(F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1)
                     & F.element_at(F.col(tags), F.lit(tag)).isNotNull()
                     & F.col(kind).isin(list(types)))


def project(df: DataFrame, mapping: Mapping[str, str] | None = None,
            first: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """SC14: rename (old -> new), drop, and move ``first`` columns to the front."""
    out = df.withColumnsRenamed(dict(mapping)) if mapping else df
    out = out.drop(*drop) if drop else out
    rest = [c for c in out.columns if c not in first]
    return out.select(*first, *rest)


def resolve_columns(df: DataFrame, wanted: Sequence[str],
                    aliases: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """SC15 (plan time): for each wanted name, the first of (name, *aliases)
    present in ``df``; names with no match are left out."""
    aliases = aliases or {}
    out = []
    for w in wanted:
        for cand in (w, *aliases.get(w, ())):
            if cand in df.columns:
                out.append(cand)
                break
    return out


def select_resolved(df: DataFrame, keys: Sequence[str], wanted: Sequence[str],
                    aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """SC15: keep keys plus the wanted features that exist, under their
    canonical names."""
    aliases = aliases or {}
    cols = []
    for w in wanted:
        for cand in (w, *aliases.get(w, ())):
            if cand in df.columns:
                cols.append(F.col(cand).alias(w))
                break
    return df.select(*keys, *cols)


def weekly_total(weekday: str, sat: str, sun: str) -> Column:
    """SC16: ``5 * weekday + saturday + sunday`` averages."""
    return F.lit(5) * F.col(weekday) + F.col(sat) + F.col(sun)
