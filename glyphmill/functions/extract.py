"""Contacts in text: first web address, mail address or telephone number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a web address, a telephone number and a mail address.
URL = r"(http|https)://((\w|-)+\.)+(\w|-)+(/(\w| |\.|/|\?|%|&|=|-)*)?"
TELEPHONE = r"1[34578][0-9]{9}"
EMAIL = r"(\w|_|-)+@(\w|_|-)+(\.(\w|_|-)+)+"


def url(text: Column) -> Column:
    return F.regexp_extract(text, URL, 0)


def telephone(text: Column) -> Column:
    return F.regexp_extract(text, TELEPHONE, 0)


def email(text: Column) -> Column:
    return F.regexp_extract(text, EMAIL, 0)


def account(text: Column) -> Column:
    """struct(kind, value) of the first that is found: url, then email, then telephone; null if none is."""
    kinds = [("url", url(text)), ("email", email(text)), ("telephone", telephone(text))]
    out = None
    for kind, value in kinds:
        row = F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        out = F.when(value != "", row) if out is None else out.when(value != "", row)
    return out
