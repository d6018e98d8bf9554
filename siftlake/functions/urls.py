"""URLs in reference tags of wiki dump lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = "&lt;ref&gt;?(.*)&lt;/ref&gt;"
URL = "((https?|telnet|gopher|file|wais|ftp)://[A-Za-z0-9_/#~:.?+=%@!;,*()-]+)"


def reference_part(line: Column) -> Column:
    """From the first opening to the last closing reference tag of a line; null without one."""
    return F.nullif(F.regexp_extract(line, REFERENCE, 0), F.lit(""))


def urls_in(text: Column) -> Column:
    """All URLs of a text, entities decoded first, without closing . : ? - , ; ! or bracket."""
    plain = F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("+"))
    return F.transform(F.regexp_extract_all(plain, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.:?,;!)-]+$", ""))
