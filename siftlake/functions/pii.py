"""Masks for personal data: each returns the masked text and how many masks it set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL_TOKEN, PHONE_TOKEN, IP_TOKEN = "|||EMAIL_ADDRESS|||", "|||PHONE_NUMBER|||", "|||IP_ADDRESS|||"
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = f"{_OCTET}([.]{_OCTET}){{3}}"
PHONE = "(^|[^0-9A-Za-z])([+]1[ .-]?)?([(][0-9]{3}[)]|[0-9]{3})[ .-]{0,2}[0-9]{3}[ .-]?[0-9]{4}\\b"

# what PHONE finds after its first character, for an engine that can look around: most characters fail the first test, and nothing but the number is consumed
_PHONE_ALONE = "(?=[+(0-9])(?<![0-9A-Za-z])(?:[+]1[ .-]?)?(?:[(][0-9]{3}[)]|[0-9]{3})[ .-]{0,2}[0-9]{3}[ .-]?[0-9]{4}\\b"


def _masked(text: Column, pattern: str, to: str) -> Column:
    return F.struct(F.regexp_replace(text, pattern, to).alias("text"), F.regexp_count(text, F.lit(pattern)).alias("n"))


def mask_emails(text: Column) -> Column:
    """struct<text, n>. A mask token that is there already holds no address, so it is not counted again."""
    return _masked(text, EMAIL, EMAIL_TOKEN.replace("$", "\\$"))


def mask_ips(text: Column) -> Column:
    """struct<text, n> for IPv4 addresses; a full stop after the address stays."""
    return _masked(text, IPV4, IP_TOKEN)


def mask_phones(text: Column) -> Column:
    """struct<text, n> for ten-digit numbers, with or without +1, brackets and separators; longer digit runs stay."""
    parts = F.split(text, _PHONE_ALONE, -1)  # one search gives text and count
    return F.struct(F.array_join(parts, PHONE_TOKEN).alias("text"), (F.array_size(parts) - 1).alias("n"))


def mask_all(text: Column) -> Column:
    """E-mail, then IP, then phone masks, so that no later pattern reads into an earlier one."""
    return mask_phones(mask_ips(mask_emails(text)["text"])["text"])["text"]
