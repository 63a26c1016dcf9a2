"""Token vault operators (inventory V1–V8, S7, K5, K6).

The vault is an append-only Parquet table ``vault(token, original,
entity_type)``.  A token never changes once written.  Tokens are
deterministic (salted sha256 of type and span), so masking needs no lookup;
the vault is only joined when restoring text or when resolving the rare
8-hex collisions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.patterns import TOKEN_SUFFIX

VAULT_SCHEMA = "token string, original string, entity_type string"

#: Leading hex digits of a token by which a committed vault is partitioned: 256 partitions.
PREFIX_LEN = 2
#: Partition of the tokens that are not the plain hash of their value (collision losers).
LOSERS = "loser"
#: Rounds in which colliding tokens of a chosen length keep that length.
SAME_LENGTH_ROUNDS = 8


def _missing(exc: Exception) -> bool:
    return any(x in str(exc) for x in ("PATH_NOT_FOUND", "does not exist", "UNABLE_TO_INFER_SCHEMA"))


class CommittedVault:
    """A stored vault that jobs commit to: partitioned by token prefix, rows of a
    job visible from the moment its entry stands in the list of jobs.

    A job writes its rows under an attempt of its own and then its entry
    ``job → attempt``, which replaces an earlier one.  Readers take the rows of
    listed attempts only, so neither an attempt that died half-way nor a job
    that runs again adds a row.  Jobs commit one after the other.

    The plain token of a value names the partition that would hold it, so a job
    reads the partitions of its own values, and that of the collision losers,
    whose tokens are no plain hashes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def jobs(self) -> DataFrame:
        """``job, attempt`` of every committed job."""
        try:
            return self.spark.read.schema("attempt string, job string").parquet(f"{self.path}/_jobs").select("job", "attempt")
        except Exception as exc:
            if not _missing(exc):
                raise
            return self.spark.createDataFrame([], "job string, attempt string")

    def rows(self, prefixes: Sequence[str] | None = None) -> DataFrame:
        """The committed rows, of some partitions only if ``prefixes`` says so."""
        try:
            stored_rows = self.spark.read.schema(VAULT_SCHEMA + ", attempt string, prefix string").parquet(self.path)
        except Exception as exc:
            if not _missing(exc):
                raise
            return empty_vault(self.spark)
        if prefixes is not None:
            stored_rows = stored_rows.where(F.col("prefix").isin([*prefixes]))
        return stored_rows.join(self.jobs().select("attempt"), "attempt", "left_semi").select("token", "original", "entity_type")

    def _of(self, prefixes: DataFrame) -> DataFrame:
        found = prefixes.distinct().collect()  # 16 ** PREFIX_LEN at most
        return self.rows([*sorted(r[0] for r in found if r[0]), LOSERS])

    def known(self, entities: DataFrame, salt: str) -> DataFrame:
        """Rows among which those of the (span, type) pairs are."""
        return self._of(entities.select(F.substring(C.token_hex("type", "span", salt), 1, PREFIX_LEN)))

    def holding(self, tokens: DataFrame) -> DataFrame:
        """Rows among which those of the ``token`` values are."""
        return self._of(tokens.select(token_prefix(F.col("token"))))

    def commit(self, delta: DataFrame, job: str, salt: str) -> bool:
        """K5: add the rows of a job; False, and nothing is written, if it is committed already."""
        if not self.jobs().where(F.col("job") == job).isEmpty():
            return False
        attempt = uuid.uuid4().hex
        plain = F.col("token") == C.token(F.col("entity_type"), F.col("original"), salt)
        own = F.when(plain, token_prefix(F.col("token"))).otherwise(F.lit(LOSERS))
        rows = delta.select("token", "original", "entity_type", F.lit(attempt).alias("attempt"), own.alias("prefix"))
        rows.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(self.path)
        entry = self.spark.createDataFrame([(attempt, job)], "attempt string, job string").coalesce(1)
        entry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job").parquet(f"{self.path}/_jobs")
        return True


def token_prefix(token: Column) -> Column:
    """The partition of a token in a committed vault."""
    digits = F.substring(F.regexp_extract(token, r"([0-9a-f]+)__\z", 1), 1, PREFIX_LEN)
    return F.when(F.char_length(digits) == PREFIX_LEN, digits).otherwise(F.lit(LOSERS))


def empty_vault(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VAULT_SCHEMA)


def vault_side(df: DataFrame) -> DataFrame:
    """The vault side of a join, without a hint.

    A derived vault is not counted up front (that would compute it twice).
    The static planner broadcasts it only under
    ``spark.sql.autoBroadcastJoinThreshold`` from size estimates, and AQE
    re-plans a sort-merge join into a broadcast one only when the shuffled
    side measured at run time is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``; past that it stays a
    sort-merge join whose skewed partitions AQE splits.
    """
    return df


def load_vault(spark: SparkSession, path: str | None) -> DataFrame:
    """Read a vault; a missing path gives an empty vault with the schema."""
    if not path:
        return empty_vault(spark)
    try:
        return spark.read.schema(VAULT_SCHEMA).parquet(path)
    except Exception as exc:  # path does not exist yet
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return empty_vault(spark)
        raise


def distinct_entities(entities: DataFrame) -> DataFrame:
    """(span, type) pairs, de-duplicated with a map-side partial aggregate."""
    return entities.select(F.col("span").alias("original"), F.col("type").alias("entity_type")).distinct()


def assign_tokens(entities: DataFrame, salt: str, vault: DataFrame | None = None) -> DataFrame:
    """V1: get-or-create a token per distinct (span, type).

    Existing vault rows keep their token; unseen pairs get the deterministic
    token.  Output ``entity_type, original, token, is_new``.
    """
    cand = distinct_entities(entities)
    fresh = C.token(F.col("entity_type"), F.col("original"), salt)
    if vault is None:
        return cand.select("entity_type", "original", fresh.alias("token"), F.lit(True).alias("is_new"))
    known = vault.select("original", "entity_type", F.col("token").alias("_known"))
    joined = cand.join(known, ["original", "entity_type"], "left")
    return joined.select(
        "entity_type",
        "original",
        F.coalesce(F.col("_known"), fresh).alias("token"),
        F.col("_known").isNull().alias("is_new"),
    )


def vault_delta(entities: DataFrame, salt: str, vault: DataFrame) -> DataFrame:
    """V3: only unseen (span, type) pairs, as vault rows ready to append."""
    cand = distinct_entities(entities)
    new = cand.join(vault.select("original", "entity_type"), ["original", "entity_type"], "left_anti")
    return new.select(C.token(F.col("entity_type"), F.col("original"), salt).alias("token"), "original", "entity_type")


def _among(taken: DataFrame, todo: DataFrame) -> DataFrame:
    """Those of the ``taken`` tokens that ``todo`` holds.  An anti-join cannot send its small left side to the tasks,
    a semi-join can its right one: where few rows are contested, the taken tokens are read but not shuffled."""
    return taken.join(todo.select("token"), "token", "left_semi")


def _decided(todo: DataFrame, taken: DataFrame | None) -> DataFrame:
    """One round, in one shuffle: the rows of ``todo`` with ``kept``, whether a row keeps its token.

    Of the pairs of a token the one that sorts first on (type, original) keeps it, unless it stands among ``taken``.
    A repeated row of that pair is dropped; a row without a token stays as it is.
    """
    rows = todo.select("token", "original", "entity_type", F.lit(False).alias("_given"))
    if taken is not None:
        none = F.lit(None).cast("string")
        given = taken.where("token is not null")
        rows = rows.unionByName(given.select("token", none.alias("original"), none.alias("entity_type"), F.lit(True).alias("_given")))
    bare = F.col("token").isNull()
    w = Window.partitionBy("token", F.when(bare, F.xxhash64("original", "entity_type"))).orderBy(F.col("_given").desc(), "entity_type", "original")
    first = F.first(F.struct("_given", "entity_type", "original")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.select("*", first.alias("_f"), F.row_number().over(w).alias("_r")).where(~F.col("_given"))
    same = F.col("_f.original").eqNullSafe(F.col("original")) & F.col("_f.entity_type").eqNullSafe(F.col("entity_type"))
    kept = bare | (F.col("_r") == 1)
    return ranked.select("token", "original", "entity_type", kept.alias("kept"), (~kept & ~F.col("_f._given") & same).alias("_again")).where("not _again").drop("_again")


def _of_digits(taken: DataFrame, digits: int) -> DataFrame:
    return taken.where(F.col("token").rlike(rf"[0-9a-f]{{{digits}}}{TOKEN_SUFFIX}\z"))


def _full(taken: DataFrame, digits: int) -> DataFrame:
    """``head``: what stands before the digits of a token, where all ``16 ** digits`` tokens that begin so are taken."""
    return _of_digits(taken, digits).groupBy(_head(digits).alias("head")).agg(F.count("*").alias("n")).where(F.col("n") >= 16**digits).select("head")


def _head(digits: int) -> Column:
    return F.col("token").substr(F.lit(1), F.char_length("token") - digits - len(TOKEN_SUFFIX))


def resolve_collisions(
    delta: DataFrame, salt: str, vault: DataFrame | CommittedVault | None = None, max_rounds: int = 64, hex_len: int | None = None,
    retoken: Callable[[Column, int | None], Column] | None = None,
) -> DataFrame:
    """V8 (fix): re-token collision losers until every token is unique.

    Per token the pair that sorts first on (type, original) keeps it unless
    the vault already has it, the others get ``hash(salt|type|span#k)`` in
    round k.  Each round is one shuffle by token (:func:`_decided`), stored.
    Tokens of the grammar's length are rarely contested: there an aggregate (a
    token used by more than one new pair) and a semi-join against the vault's
    tokens find the contested ones, every other row is settled as is, and the
    tokens given away meet the few rows of a round first (:func:`_among`).
    ``retoken`` gives the token of a round, where it is no vault token: so many
    hex digits and the suffix, behind what stays the same in all rounds.

    A type has ``16 ** hex_len`` tokens and cannot hold more distinct values.
    Where the caller chose ``hex_len``, tokens after ``SAME_LENGTH_ROUNDS``
    rounds therefore get one digit more a round, which always ends; rows of a
    type whose tokens are all given away wait for that round, as none before
    could settle them.  The token grammar has 8 digits (2^32 tokens a type);
    there the round bound raises, never truncates.
    """
    from ..session import stored

    if retoken is None:
        retoken = lambda k, digits: C.token_with_nonce(F.col("entity_type"), F.col("original"), salt, k, digits)
    cur = delta.select("token", "original", "entity_type")
    committed = isinstance(vault, CommittedVault)
    given = vault.holding(cur) if committed else vault
    vault_tokens = given.select("token").distinct() if given is not None else None
    taken = [] if vault_tokens is None else [vault_tokens]  # every token that is already given away
    settled, waiting, todo, digits = [], [], cur, hex_len
    if hex_len is None:
        dup = cur.groupBy("token").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("token")
        contested = dup if vault_tokens is None else dup.unionByName(cur.select("token").join(vault_tokens, "token", "left_semi"))
        contested = stored(contested.distinct(), "contested")
        settled.append(stored(cur.join(contested, "token", "left_anti"), "settled"))
        taken.append(settled[0].select("token"))
        todo = stored(cur.join(contested, "token", "left_semi"), "contested_rows")
    elif vault_tokens is not None:
        taken = [stored(vault_tokens, "taken")]
    every = lambda parts: reduce(DataFrame.unionByName, parts)
    for k in range(1, max_rounds + 1):
        losers = []
        if (k == 1 and hex_len is not None) or not todo.isEmpty():
            near = lambda t: _among(t, todo) if hex_len is None else t if k == 1 else _of_digits(t, digits)
            marks = [near(every(taken))] if taken else []
            if committed and k > 1:  # tokens of later rounds stand in other partitions
                marks.append(vault.holding(todo).select("token"))
            decided = stored(_decided(todo, every(marks) if marks else None), "collision_round")
            settled.append(decided.where("kept").drop("kept"))
            taken.append(settled[-1].select("token"))
            losers = [decided.where("not kept").drop("kept")]
        elif not waiting:
            return every(settled)
        again = None if hex_len is None else hex_len + max(0, k - SAME_LENGTH_ROUNDS)
        if again != digits:
            losers, waiting, digits = losers + waiting, [], again
            taken = taken[: 1 + (vault_tokens is not None)]  # the vault's and those of the first round; the others have fewer digits
        elif losers and hex_len is not None:
            full = stored(_full(every(taken), digits), "full")
            waiting.append(losers[0].join(full, _head(digits) == F.col("head"), "left_semi"))
            losers = [losers[0].join(full, _head(digits) == F.col("head"), "left_anti")]
        todo = every(losers) if losers else cur.limit(0)
        todo = todo.select(retoken(F.lit(k), digits).alias("token"), "original", "entity_type")
        if losers and hex_len is None:
            todo = stored(todo, "contested_rows")
    raise RuntimeError("token collisions not resolved after %d rounds" % max_rounds)


def plan_tokens(entities: DataFrame, salt: str, vault: DataFrame | CommittedVault | None = None) -> tuple[DataFrame, DataFrame]:
    """V1 + V3 + V8 for one batch: ``(assignments, delta)``.

    ``delta`` holds the new vault rows with collision-free tokens (checked
    against the vault and each other), stored as Parquet in the shared
    scratch folder; ``assignments`` is every distinct (original,
    entity_type) of the batch with its final token.  Only distinct entity
    pairs are shuffled, never texts.
    """
    from ..session import stored

    if vault is None:
        new = distinct_entities(entities).select(
            C.token(F.col("entity_type"), F.col("original"), salt).alias("token"), "original", "entity_type"
        )
        delta = stored(resolve_collisions(stored(new, "new_entities"), salt), "vault_delta")
        return delta, delta
    prior = vault.known(entities, salt) if isinstance(vault, CommittedVault) else vault
    delta = stored(resolve_collisions(stored(vault_delta(entities, salt, prior), "new_entities"), salt, vault), "vault_delta")
    known = distinct_entities(entities).join(
        prior.select("token", "original", "entity_type"), ["original", "entity_type"], "inner"
    ).select("token", "original", "entity_type")
    return known.unionByName(delta), delta


def overrides_of(assignments: DataFrame, salt: str) -> DataFrame:
    """Assignments whose token is not the plain hash (collision losers)."""
    return assignments.filter(
        F.col("token") != C.token(F.col("entity_type"), F.col("original"), salt)
    ).select("original", "entity_type", "token")


def token_collisions(vault: DataFrame) -> DataFrame:
    """V8 (audit): tokens that map to more than one (original, type)."""
    return (
        vault.groupBy("token")
        .agg(F.count("*").alias("n_rows"), F.countDistinct("original", "entity_type").alias("n_entities"))
        .filter(F.col("n_entities") > 1)
    )


def token_consistency(assignments: DataFrame) -> DataFrame:
    """V2: per (original, type) the number of distinct tokens (must be 1)."""
    return assignments.groupBy("entity_type", "original").agg(F.countDistinct("token").cast("long").alias("n_tokens"))


def masked_entities(masked: DataFrame, text_col: str, id_cols: Sequence[str], vault: DataFrame) -> DataFrame:
    """V4: tokens present in each text with their originals.

    Unknown tokens are omitted; one row per distinct token per text with its
    first-seen rank (``first_pos``).
    """
    toks = C.posexplode_rows(masked, id_cols, C.token_spans(text_col), "pos", "token")
    first = toks.groupBy(*id_cols, "token").agg(F.min("pos").cast("long").alias("first_pos"))
    v = vault_side(vault.select("token", "original", "entity_type"))
    return first.join(v, "token", "inner").select(*id_cols, "first_pos", "token", "original", "entity_type")


def token_coverage(masked: DataFrame, text_col: str, id_cols: Sequence[str], vault: DataFrame) -> DataFrame:
    """V5: per text, tokens found vs tokens the vault resolves."""
    toks = C.explode_rows(masked, id_cols, C.token_spans(text_col), "token")
    v = vault_side(vault.select(F.col("token").alias("_vt")).distinct())
    j = toks.join(v, toks.token == v._vt, "left")
    return j.groupBy(*id_cols).agg(
        F.count("token").cast("long").alias("n_found"), F.count("_vt").cast("long").alias("n_resolved")
    )


def export_vault(vault: DataFrame) -> DataFrame:
    """K6: ``token, json`` with ``{"original_text": …, "entity_type": …}``."""
    return vault.select(
        "token",
        F.to_json(F.struct(F.col("original").alias("original_text"), "entity_type")).alias("value"),
    )


def save_vault(delta: DataFrame, path: str) -> None:
    """K5: append new rows (callers pass the V3 delta, so tokens never change).
    A job that may run again uses :class:`CommittedVault`."""
    delta.select("token", "original", "entity_type").write.mode("append").parquet(path)


def clear_vault(spark: SparkSession, path: str) -> DataFrame:
    """Replace the stored table with an empty one of the same schema."""
    empty_vault(spark).write.mode("overwrite").parquet(path)
    return load_vault(spark, path)
