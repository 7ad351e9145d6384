"""Several values packed in one field: one value per row, position kept.

The text is split on quote characters. Odd pieces are literals and are never cut;
even pieces are cut on delimiters. Array folds put the pieces together again, so a
value may run over the border of a piece, and every value gets its ordinal. All of
it is Column expressions: no shuffle, no Python, one pass over the rows.

Defined results: null, empty and blank fields give no values; empty values between
two delimiters have no position; an unclosed quote is an ordinary character; a
repeated value keeps each of its positions; texts of any length are split whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quote characters, opening and closing.
OPENING, CLOSING = "\"“«'‘„", "\"”»'’“"
_BEFORE, _AFTER = ",;/|&+·•–—\\-\\[({\\s", ",;/|&+·•–—\\-\\])}.\\s"
_OPEN, _CLOSE, _KEEP, _CUT = "", "", "", ""

#: Words that join two values.
JOINERS = ["y también", "así como", "además de", "junto con", "y", "e"]
#: Words that, after a comma, open a place or remark of the value before.
REMARKS = ["de", "del", "desde", "en"]

_VARIANTS = {"a": "aá", "e": "eé", "i": "ií", "o": "oó", "u": "uúü", "n": "nñ"}


def _loose(word: str) -> str:
    """Pattern for a word whatever its accents."""
    return "".join(f"[{_VARIANTS[c]}]" if c in _VARIANTS else re.escape(c) for c in word.lower())


def _slip(word: str) -> str:
    """Pattern for a word with at most one slip (letter lost, added, changed or swapped)."""
    forms = [_loose(word)]
    if len(word) > 2:
        for k in range(len(word)):
            forms.append(_loose(word[:k]) + "\\p{L}?" + _loose(word[k + 1 :]))
            forms.append(_loose(word[:k]) + "\\p{L}" + _loose(word[k:]))
            if k + 1 < len(word):
                forms.append(_loose(word[:k] + word[k + 1] + word[k] + word[k + 2 :]))
    return "(?:" + "|".join(dict.fromkeys(forms)) + ")"


def compound_heads(names: DataFrame, column: str, limit: int = 500) -> list[str]:
    """What precedes the last word in names that hold a separator or conjunction.

    ``Agua, Tierra y Norte`` gives ``Agua, Tierra y``. The distinct heads are counted
    first: they come from a reference list, and more than ``limit`` of them raises.
    """
    joiner = "|".join(_loose(j) for j in JOINERS)
    name = F.trim(F.col(column))
    heads = (
        names.where(name.rlike(f"(?iu)(?:,| (?:{joiner}) )"))
        .select(F.lower(F.regexp_extract(name, f"(?iu)^(.*(?:,|\\s(?:{joiner})))\\s+\\S+$", 1)).alias("head"))
        .where("head <> ''")
        .distinct()
        .limit(limit + 1)
        .collect()
    )
    if len(heads) > limit:
        raise ValueError(f"more than {limit} compound name heads; raise the limit or clean the reference list")
    return sorted(r.head for r in heads)


def _guard_heads(text: Column, heads: list[str]) -> Column:
    """Mark the separators inside known compound names so that they don't cut."""
    for head in sorted(heads, key=lambda h: (-len(h), h)):
        parts = re.findall(r"[^\s,]+|,", head)
        pattern, target, group = "(?iu)(?<!\\p{L})", "", 0
        for k, part in enumerate(parts):
            if part == ",":
                pattern += "(\\s*)(,)"
                target += f"${group + 1}{_KEEP}${group + 2}"
                group += 2
            else:
                last = k == len(parts) - 1
                body = _loose(part) if last else _slip(part)
                pattern += (f"(\\s+)({body})" if k else f"({body})") if parts[k - 1] != "," or not k else f"(\\s*)({body})"
                if k:
                    target += f"${group + 1}" + (_KEEP if last else "") + f"${group + 2}"
                    group += 2
                else:
                    target += f"${group + 1}"
                    group += 1
        text = F.regexp_replace(text, pattern + "(?=\\s)", target)
    return text


def _cut(text: Column) -> Column:
    """Delimiters of an even piece become the cut mark."""
    outside = "(?![^(]*\\))"
    joiner = "|".join(_loose(j).replace("\\ ", "\\s+") for j in JOINERS)
    remark = "|".join(REMARKS)
    signs = f"(?:[;|\\n\\r\\t·•+&]|//+|(?<![0-9])(?<!\\b[\\p{{L}}])/|/(?![0-9])(?!\\p{{L}}\\b)|\\s[-–—](?=\\s)){outside}"
    commas = f"(?<!{_KEEP}),(?!\\s*(?:{remark})\\s){outside}"
    text = F.regexp_replace(text, f"(?iu){signs}", _CUT)
    text = F.regexp_replace(text, f"(?iu){commas}", _CUT)
    return F.regexp_replace(text, f"(?iu)(?<=[\\s{_CUT}]|^)(?:{joiner})(?=\\s|$){outside}", _CUT)


def _trim_brackets(value: Column) -> Column:
    """Blanks, then list brackets and stray commas around a value."""
    value = F.regexp_replace(value, "^[\\s\\u00a0\\u200b\\[{,]+|[\\s\\u00a0\\u200b\\]},]+$", "")
    return F.regexp_replace(value, "^\\(([^()]*)\\)$", "$1")


def packed_values(c: Column, heads: list[str] | None = None) -> Column:
    """The values of a packed field, in order, as an array of strings."""
    text = F.coalesce(c, F.lit(""))
    # A quote counts only at the edge of a value, so an apostrophe inside a word is none.
    text = F.regexp_replace(text, f"(?<=^|[{_BEFORE}])([{OPENING}])(?=[\\p{{L}}\\p{{N}}(¿¡#@])", _OPEN + "$1")
    text = F.regexp_replace(text, f"(?<=[\\p{{L}}\\p{{M}}\\p{{N}}.)!?…%])([{CLOSING}])(?=$|[{_AFTER}])", "$1" + _CLOSE)
    # Only pairs survive; unpaired marks are taken out again.
    text = F.regexp_replace(text, f"{_OPEN}([^{_OPEN}{_CLOSE}]*){_CLOSE}", "$1")
    text = F.translate(text, _OPEN + _CLOSE, "")
    pieces = F.split(text, "")
    marked = F.transform(
        pieces,
        lambda piece, k: F.when(k % 2 == 1, F.concat(F.lit(""), piece, F.lit(""))).otherwise(
            # Blank between two literals separates them; else cut on the delimiters.
            F.when(
                (F.trim(piece) == "") & (k > 0) & (k < F.size(pieces) - 1), F.lit(_CUT)
            ).otherwise(_cut(_guard_heads(piece, heads or [])))
        ),
    )
    joined = F.aggregate(marked, F.lit(""), lambda left, right: F.concat(left, right))
    values = F.transform(
        F.split(joined, _CUT),
        lambda v: _trim_brackets(
            F.regexp_replace(F.regexp_replace(_trim_brackets(v), "^.(.*).$", "$1"), f"[{_KEEP}]", "")
        ),
    )
    return F.filter(values, lambda v: v != "")


def split_packed(df: DataFrame, column: str, keys: list[str], heads: list[str] | None = None, least: int = 1,
                 value: str = "valor", position: str = "posicion") -> DataFrame:
    """One row per value: ``keys``, ``position`` from 1, ``value``.

    ``least`` keeps only fields that hold at least so many values. Rows that repeat
    their key count once; columns other than ``keys`` and ``column`` are ignored, so
    their names can't clash. An empty table gives an empty result.
    """
    # Fields are split where they are read, by as many tasks as read them; what travels is the values of the fields that count.
    values = df.select(*keys, packed_values(F.col(column), heads).alias("__values"))
    rows = values.where(F.size("__values") >= least).dropDuplicates(keys)
    return rows.select(*keys, F.posexplode("__values").alias("__at", value)).select(
        *keys, (F.col("__at") + 1).cast("int").alias(position), value
    )
