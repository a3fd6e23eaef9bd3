"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Patterns propose candidates.  The hash of each candidate's value is counted over
distinct repositories and owners of the whole corpus: values that many owners or
repositories share are copied examples, values of one owner in one repository
look live.  The loose patterns (passwords in addresses, private key blocks, bearer
tokens, opaque runs) count only where the value looks live.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import materialize, row_key, whole_text


@dataclass(frozen=True)
class Kind:
    """``group`` of ``pattern`` is the secret value; it needs ``least`` characters and a match of each of ``holds``.

    Only texts that contain ``sign`` are searched.
    """

    name: str
    pattern: str
    group: int
    least: int
    base: bool = True
    holds: tuple[str, ...] = ()
    sign: str = ""


KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", r"[0-9a-f]+", 0, 24),
    Kind("uri", r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\x20\x09-\x0D/@:"'<>]*+:([^\x20\x09-\x0D/@"'<>]++)@""", 1, 6, base=False, sign="://"),
    Kind("key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----([A-Za-z0-9+/=\x20\x09-\x0D]++)-----END", 1, 40, base=False, sign="-----BEGIN"),
    Kind("bearer", r"(?i:bearer|basic)\x20++([A-Za-z0-9+/_.~=-]++)", 1, 16, base=False, holds=("[0-9]", "[A-Za-z]")),
    Kind("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", 0, 24, base=False, holds=("[0-9]", "[A-Z]", "[a-z]")),
)

SPAN = "struct<start:int,rank:int,end:int,value:string>"


def _scan_pattern(kind: Kind) -> str:
    """For a plain character run, a run shorter than ``least`` cannot match at all, which spares the dropped hits."""
    if kind.name == "access":
        return r"AKIA[A-Z0-9]{16,}"
    if kind.name == "hex":
        return r"[0-9a-f]{24,}"
    return kind.pattern


#: Hits of a text that are placed in one pass; appending to an array copies it, so passes are kept short.
PASS = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """Spans of one kind, in code points, from the hits and the gaps between them.

    Hits are placed in passes of ``PASS``, each from the end of the one before.
    """
    pattern = F.lit(_scan_pattern(kind))
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")
    state = f"struct<at:int,out:array<{SPAN}>>"
    length = lambda piece: F.char_length(piece["gap"]) + F.coalesce(F.char_length(piece["hit"]), F.lit(0))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.char_length(piece["gap"])
        end = acc["at"] + length(piece)
        value = piece["value"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), value.alias("value"))
        fits = F.char_length(value) >= kind.least
        for held in kind.holds:
            fits = fits & value.rlike(held)
        return F.struct(end.alias("at"), F.when(fits, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")).cast(state)

    def one_pass(pieces: Column, at: Column) -> Column:
        return F.aggregate(pieces, F.struct(at.alias("at"), none.alias("out")).cast(state), step, lambda acc: acc["out"])

    def in_passes(passes: Column) -> Column:
        sizes = F.transform(passes, lambda pieces: F.aggregate(pieces, F.lit(0), lambda n, piece: n + length(piece)))
        begins = F.aggregate(
            sizes,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast("struct<at:int,out:array<int>>"),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(
                "struct<at:int,out:array<int>>"
            ),
            lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(passes, begins, one_pass))

    def cut(pieces: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.size(pieces) - 1).cast("int"), F.lit(PASS)), lambda i: F.slice(pieces, i + 1, PASS))

    def placed(found: Column) -> Column:
        gaps = F.split(text, _scan_pattern(kind), -1)
        values = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else found
        pieces = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("value"))
        few = F.size(found) < PASS
        return F.when(few, one_pass(pieces, F.lit(0))).otherwise(_let(pieces, lambda p: _let(cut(p), in_passes)))

    seen = F.size(hits) > 0
    return F.when(F.contains(text, F.lit(kind.sign)) & seen if kind.sign else seen, _let(hits, placed)).otherwise(none)


def find_candidates(df: DataFrame, id_col: str, text_col: str, owner_col: str, repository: Column) -> DataFrame:
    """Per row: id, row key, owner, repository, the sorted base spans, and the loose candidates.

    A loose candidate overlaps no base span, and one of the last kind, whose
    pattern says least, none of another loose kind.
    """
    found = df.select(
        F.col(id_col).alias("doc_id"),
        row_key(id_col, whole_text(text_col)).alias("key"),
        F.col(owner_col).cast("string").alias("owner"),
        repository.alias("repository"),
        whole_text(text_col).alias("__text"),
    )
    head = ["doc_id", "key", "owner", "repository"]
    spans = found.select(*head, *[_spans(F.col("__text"), kind, rank).alias(f"__{kind.name}") for rank, kind in enumerate(KINDS)])
    base = F.concat(*[F.col(f"__{kind.name}") for kind in KINDS if kind.base])
    loose = F.concat(*[F.col(f"__{kind.name}") for kind in KINDS if not kind.base])
    overlaps = lambda x, spans, kinds: F.exists(spans, lambda b: kinds(b) & (b["start"] < x["end"]) & (x["start"] < b["end"]))
    last = len(KINDS) - 1
    met = lambda x: overlaps(x, "base", lambda b: F.lit(True)) | ((x["rank"] == last) & overlaps(x, "loose", lambda b: b["rank"] < last))
    return spans.select(*head, F.sort_array(base).alias("base"), loose.alias("loose")).select(
        *head, "base", F.filter("loose", lambda x: ~met(x)).alias("loose")
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value hash: distinct owners, distinct repositories, and documents.

    Aggregated to (value, owner, repository) first, so a value found in a third
    of the corpus leaves each map task as a few rows.
    """
    per_place = candidates.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_place.groupBy("value_hash", "owner").agg(
        F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n")
    )
    return per_owner.groupBy("value_hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_hits")
    )


def text_of(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository: Column | None = None,
    example_owners: int = 3,
    example_repositories: int = 4,
) -> DataFrame:
    """Per row: ``spans`` (array of start, rank, end, value), ``n_live`` and ``n_example``.

    The repository is the owner and, where there is one, the language, unless
    ``repository`` gives another.  A value is live if one owner has it in one
    repository, and an example if ``example_owners`` owners or more have it, or
    if it lies in ``example_repositories`` repositories or more; between the two
    it is neither.  Base spans always stay; a loose candidate becomes a span if
    its value is live and it overlaps no base span.  A null text is empty; null
    owners and repositories are values of their own.  Rows are judged one by one,
    also where they repeat an id.  An empty table gives an empty result.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (owner_col, "lang") if c in df.columns]
    place = F.concat_ws("/", *parts) if repository is None else repository
    found = materialize(find_candidates(df, id_col, text_col, owner_col, place), "secret-candidates")
    hits = found.select("key", "owner", "repository", F.explode(F.concat("base", "loose")).alias("span"))
    hits = hits.withColumn("value_hash", F.md5(F.col("span.value")))
    counts = materialize(ownership(hits), "secret-ownership")
    live = (F.col("n_owners") == 1) & (F.col("n_repositories") == 1)
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories)
    loose = F.col("span.rank").isin([rank for rank, kind in enumerate(KINDS) if not kind.base])
    # Rows that share a key have equal texts and so equal spans: one row of a span stands for all.
    single = hits.select("key", "span", "value_hash").distinct().join(counts, "value_hash")
    verdicts = single.groupBy("key").agg(
        F.count_if(live).alias("n_live"),
        F.count_if(example).alias("n_example"),
        F.collect_set(F.when(live & loose, F.col("span"))).alias("added"),
    )
    joined = found.join(verdicts, "key", "left")
    return joined.select(
        F.col("doc_id").alias(id_col),
        "base",
        F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
    )
