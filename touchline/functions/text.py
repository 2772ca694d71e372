"""Text expressions. All of them fold ASCII only, as identities are compared byte by byte elsewhere."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]"


def is_blank(text: Column) -> Column:
    """Empty or white space only."""
    return text.rlike(rf"\A{SPACE}*\z")


def fold_case(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def identity_name(text: Column) -> Column:
    """Names as they are compared: white space trimmed and collapsed, ASCII lower case."""
    return fold_case(F.trim(F.regexp_replace(text, rf"{SPACE}+", " ")))


def title_case(text: Column) -> Column:
    """Upper case at the start and after each space or hyphen, lower case elsewhere (SET PIECE: Set Piece)."""
    upper = lambda c: F.translate(c, string.ascii_lowercase, string.ascii_uppercase)
    word = lambda w: F.concat(upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    each = lambda s, sep: F.array_join(F.transform(F.split(s, sep), word), sep)
    return F.array_join(F.transform(F.split(fold_case(text), " "), lambda part: each(part, "-")), " ")


def reference_text(provider: Column, provider_id: Column, match_id: Column | None = None) -> Column:
    """provider:id, with @match where the reference is scoped to one."""
    text = F.concat(provider, F.lit(":"), provider_id)
    return text if match_id is None else F.concat(text, F.coalesce(F.concat(F.lit("@"), match_id), F.lit("")))


def score_text(home: Column, away: Column) -> Column:
    """home-away, null if either is."""
    return F.concat(home.cast("string"), F.lit("-"), away.cast("string"))
