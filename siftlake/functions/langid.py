"""Language identification by script and by function words: ``struct<label, score>``, score in (0, 1]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPTS = {"zh": "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}", "ja": "\\x{3040}-\\x{30FF}", "ko": "\\x{AC00}-\\x{D7AF}", "ru": "\\x{0400}-\\x{04FF}", "ar": "\\x{0600}-\\x{06FF}", "el": "\\x{0370}-\\x{03FF}", "he": "\\x{0590}-\\x{05FF}", "hi": "\\x{0900}-\\x{097F}", "th": "\\x{0E00}-\\x{0E7F}"}
WORDS = {
    "en": "the of and to in that is was for it with as on be by this are from or an at not have he his her they you we which but had were their would been one all there when who will more no if out so up what about than them can only other into some could these two may then do first any my now such like our over me even most made after also did many before must through where much your way well down should because each just those people how too good very".split(),
    "fr": "le la les des une est dans pour qui sur avec par pas au du et ce il elle nous vous ne se plus sont mais comme ou si leur cette aux tout fait deux ont être même aussi".split(),
    "de": "der die das und ist von den mit dem des sich auf für nicht ein eine im zu auch als an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde".split(),
    "es": "el los las que de en y un una por con para se del no su al es lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante".split(),
}


def _in(terms: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*terms)


_ANY = "[" + "".join(SCRIPTS.values()) + "]"


def identify(text: Column) -> Column:
    """The best label and its share of the evidence; text without any evidence is ``und`` with score 0.01, null gives null.

    A letter of a script counts as one, a function word as four. Ties go to the label that comes last in the alphabet.
    Words are split once: lambda variables hold what is used more than once. Texts without a letter of the listed scripts skip their counts.
    """
    scripts = [F.struct(F.regexp_count(text, F.lit(f"[{r}]")).cast("long").alias("score"), F.lit(k).alias("label")) for k, r in SCRIPTS.items()]
    none = [F.struct(F.lit(0).cast("long").alias("score"), F.lit(k).alias("label")) for k in SCRIPTS]
    found = F.filter(F.split(F.lower(text), "[^\\p{L}]+"), _in(sorted({w for v in WORDS.values() for w in v})))

    def best(x: Column) -> Column:
        words = [F.struct((F.size(F.filter(x["w"], _in(v))) * 4).cast("long").alias("score"), F.lit(k).alias("label")) for k, v in WORDS.items()]
        return F.struct(F.concat(x["s"], F.array(*words)).alias("e"))

    def verdict(x: Column) -> Column:
        top = F.array_max(x["e"])
        return F.struct(top.alias("top"), F.aggregate(x["e"], F.lit(0).cast("long"), lambda a, b: a + b["score"]).alias("total"))

    def result(x: Column) -> Column:
        hit = x["top"]["score"] > 0
        share = F.when(hit, F.try_divide(x["top"]["score"], x["total"])).otherwise(F.lit(0.01)).cast("double")
        return F.struct(F.when(hit, x["top"]["label"]).otherwise("und").alias("label"), share.alias("score"))

    made = F.array(F.struct(found.alias("w"), F.when(text.rlike(_ANY), F.array(*scripts)).otherwise(F.array(*none)).alias("s")))
    for step in (best, verdict, result):
        made = F.transform(made, step)
    return F.when(text.isNotNull(), made[0])
