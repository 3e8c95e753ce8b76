"""Names: result files, checkpoints, models, crops; hash buckets; coded transcriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVIDERS = ("openai", "hf", "gemini", "mistral")


def stem(path: Column) -> Column:
    """File name without folders and last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def result_file(stem_: Column) -> Column:
    """{dataset, method} of a result file's stem."""
    s = F.lower(stem_)
    by_dataset, by_method, other = r"^(.+?)_eval_(.+)$", r"^evaluation_(m[123])_(.+)$", r"^evaluation_(.+)$"
    dataset = F.when(s.rlike(by_dataset), F.regexp_extract(s, by_dataset, 1)).when(s.rlike(by_method), F.regexp_extract(s, by_method, 2)).when(s.rlike(other), F.lit("evaluation")).otherwise(s)
    method = F.when(s.rlike(by_dataset), F.regexp_extract(s, by_dataset, 2)).when(s.rlike(by_method), F.regexp_extract(s, by_method, 1)).when(s.rlike(other), F.regexp_extract(s, other, 1)).otherwise(F.lit("unknown"))
    return F.struct(dataset.alias("dataset"), method.alias("method"))


def checkpoint_name(method: Column, dataset: Column, model: Column, n_shots: Column) -> Column:
    safe = F.translate(model, "/:", "__")
    return F.concat(F.lit("checkpoint_"), method, F.lit("_"), F.element_at(F.split(F.regexp_replace(dataset, "/+$", ""), "/"), -1), F.lit("_"), safe, F.lit("_"), n_shots.cast("string"), F.lit("shot.json"))


def provider(model_id: Column) -> Column:
    """{provider, model}: a known prefix before the first slash, else hf and the whole id."""
    prefix = F.lower(F.substring_index(model_id, "/", 1))
    known = F.contains(model_id, F.lit("/")) & prefix.isin(*PROVIDERS)
    return F.struct(F.when(known, prefix).otherwise(F.lit("hf")).alias("provider"), F.when(known, F.regexp_replace(model_id, r"^[^/]*/", "")).otherwise(model_id).alias("model"))


def run_name(method: str, n_shots: int, named: str | None = None) -> str:
    """Default name of a run's outputs; a name that was given is kept."""
    return named or (f"evaluation_{method}_{n_shots}shot")


def crop_name(page_stem: Column, index: Column) -> Column:
    """Three digits at least; larger numbers keep all of theirs."""
    return F.concat(page_stem, F.lit("_line"), F.format_string("%03d", index), F.lit(".png"))


def hash_bucket(key: Column, seed: int = 13, buckets: int = 1000) -> Column:
    """sha1("seed:key") as a number, modulo buckets: folded over hex digits, so no 160-bit number is needed."""
    digits = F.split(F.sha1(F.concat(F.lit(f"{seed}:"), key).cast("binary")), "")
    value = lambda d: F.conv(d, 16, 10).cast("int")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: ((a * 16 + value(d)) % buckets).cast("int"))


def in_validation(key: Column, ratio: float = 0.1, seed: int = 13) -> Column:
    return hash_bucket(key, seed) < int(ratio * 1000)


#: Codes of signs in coded transcriptions: fixed values.
SIGNS = {"cm": ",", "pt": ".", "sq": ";", "qt": "'", "qo": ":", "mi": "-", "s": "s", "GW": "GW"}


def decode_token(token: Column) -> Column:
    """Pieces between hyphens: letters as they are, s_ codes as signs, digits or ordinals; unknown codes are empty."""
    table = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])

    def piece(p: Column) -> Column:
        code = F.substring(p, 3, 2**31 - 1)
        number = F.when(code.rlike(r"^[0-9]+(st|nd|rd|th)?$"), code).otherwise(F.lit(""))
        return F.when(p.startswith("s_"), F.coalesce(F.try_element_at(table, code), number)).otherwise(p)

    return F.array_join(F.transform(F.split(token, "-"), piece), "")


def decode_line(encoded: Column) -> Column:
    """Tokens between bars, joined by spaces; a lone hyphen hangs on the token before."""
    words = F.filter(F.transform(F.split(encoded, r"\|"), decode_token), lambda t: t != "")
    glued = F.aggregate(words, F.lit(""), lambda a, t: F.when((t == "-") | (a == ""), F.concat(a, t)).otherwise(F.concat(a, F.lit(" "), t)))
    return F.regexp_replace(glued, r"^\s+|\s+$", "")


def page_digits(stem_: Column) -> Column:
    """All digits of a stem: the id of a page image."""
    return F.regexp_replace(stem_, r"[^\p{Nd}]", "")
