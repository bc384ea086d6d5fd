"""Secret scan: candidates from patterns, judged by who owns them across the corpus.

A candidate's hash is counted over distinct repositories and owners. One that many owners
share is a copied example; one that a single owner has looks live. Only spans and hashes
are shuffled, never texts, and every aggregate is combined before its shuffle: first by
(hash, owner, repository), then (hash, owner), then hash, so that a hash held by a third of
all rows is spread over its owners' repositories and arrives as one row each. Counts go back to
the rows by a shuffle on the hash, but for hashes with more than one in ``1 / HOT`` of all occurrences: there
are fewer than ``HOT`` of those by their definition, and they are broadcast.

Defined results: a null text is empty; a null owner or repository counts as one unnamed
owner or repository, and so do all rows of a table without the columns of the defaults; repeated rows
are scanned each on their own; an empty table gives an empty result; other columns are ignored. Very long
texts are scanned whole; spans of different kinds at one place are each reported, in the order of the kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.spans import flat, matches
from lumenlake.llm.store import Stage

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_WORDS = r"(?i)passw(?:or)?d|secret|token|api_?key"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Added kind: long mixed-class tokens, kept where a single owner has them.
ENTROPY = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "entropy")
#: A value that so many owners hold is a copied example.
SHARED_OWNERS = 3
#: Most hashes whose counts are broadcast.
HOT = 1_000


def _tagged(spans: Column, kind: str, value=lambda x: x["m"]) -> Column:
    return F.transform(
        spans,
        lambda x: F.struct(x["s"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), x["e"].alias("end"), F.unhex(F.sha2(value(x), 256)).alias("hash")),
    )


def candidates(text: Column) -> Column:
    """All candidates by start, then kind: array<struct<start,kind_no,end,hash>>."""
    group2 = lambda m: F.regexp_extract(m, ASSIGN, 2)
    assign = F.filter(matches(text, ASSIGN, text.rlike(ASSIGN_WORDS)), lambda x: F.length(group2(x["m"])) >= 6)
    access = matches(text, ACCESS, F.contains(text, F.lit("AKIA")))
    hexes = matches(text, HEX, text.rlike(HEX))
    mixed = matches(text, ENTROPY, text.rlike(r"[A-Za-z0-9+/_-]{24}"))
    mixed = F.filter(mixed, lambda x: x["m"].rlike("[a-z]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[0-9].*[0-9]"))
    return F.array_sort(
        F.concat(_tagged(assign, "assign", lambda x: group2(x["m"])), _tagged(access, "access"), _tagged(hexes, "hex"), _tagged(mixed, "entropy"))
    )


def ownership(occurrences: DataFrame) -> DataFrame:
    """hash, n_rows, n_repos, n_owners from rows of (hash, owner, repo)."""
    return (
        occurrences.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
        .groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
        .groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
    )


def scan_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, shared_owners: int = SHARED_OWNERS
) -> DataFrame:
    """``id_col`` and ``findings`` array<struct<start,kind,end,hash,n_repos,n_owners,live>> per input row.

    ``owner`` and ``repo`` default to ``source`` and (``source``, ``lang``). Base kinds are
    always reported; ``entropy`` spans only where they look live. ``live`` means fewer than
    ``shared_owners`` owners. Findings are ordered by start, then kind.
    """
    spark = df.sparkSession
    stage = Stage(spark)
    named = lambda *names: F.concat_ws("/", *[F.col(c) for c in names if c in df.columns]) if set(names) & set(df.columns) else F.lit("")
    owner = named("source") if owner is None else owner
    repo = named("source", "lang") if repo is None else repo
    # Row numbers are fixed by writing them: a retry of this stage cannot change those read later.
    rows = stage.table(
        df.select(
            F.monotonically_increasing_id().alias("row_no"),
            F.col(id_col).alias("id_"),
            F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
            F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
            candidates(flat(F.col(text_col))).alias("found"),
        ),
        "secret-rows",
    )
    each = rows.where(F.size("found") > 0).select("row_no", "owner", "repo", F.explode("found").alias("x")).select("row_no", "owner", "repo", "x.*")
    owners = stage.table(ownership(each), "secret-owners")
    often = owners.agg(F.sum("n_rows")).first()[0] or 0
    hot = owners.where(F.col("n_rows") * HOT > often)
    counted = each.join(F.broadcast(hot), "hash").unionByName(each.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(owners, "hash"))
    judged = (
        counted
        .withColumn("live", F.col("n_owners") < shared_owners)
        .where((F.col("kind_no") < 3) | F.col("live"))
        .groupBy("row_no")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("start", "kind_no", "end", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind_no") + 1).alias("kind"), "hash", "n_repos", "n_owners", "live")
                )
            ).alias("findings")
        )
    )
    none = F.array().cast(judged.schema["findings"].dataType)
    return rows.select("row_no", "id_").join(judged, "row_no", "left").select(F.col("id_").alias(id_col), F.coalesce("findings", none).alias("findings"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("findings", lambda x: x["kind_no"] < 3)
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: lambda x: x["kind"] == k
    count = lambda f: F.size(F.filter("findings", f)).cast("long")
    return found.select(
        id_col,
        *[count(of(k)).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("findings")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_shared"),
    )
