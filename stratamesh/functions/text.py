"""String normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it, with the four separators that the property leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Unicode NFC. ASCII text is NFC already and is not sent to Python."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def squeeze(c: Column) -> Column:
    """One space for each run of white space, none at the ends. Null stays null, blank becomes empty."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def canonical(c: Column) -> Column:
    """The form under which two written values count as the same: NFC, trimmed, single spaces."""
    return squeeze(nfc(c))


def tidy_id(c: Column) -> Column:
    """Trimmed and in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
