"""Collision rounds where a type holds more values than tokens: rows wait until tokens get longer."""

from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.operators import vault
from maskloom.session import stored


def rounds(rows, held, salt, digits):
    """The rounds one after the other, every row in each."""
    token = lambda t, o, k, n: f"__MASKED_{t.lower()}_{sha256(f'{salt}|{t}|{o}{k}'.encode()).hexdigest()[:n]}__"
    taken, done, todo, k = set(held), {}, {(t, o): token(t, o, "", digits) for t, o in rows}, 0
    while todo:
        k += 1
        of = defaultdict(list)
        for pair, x in todo.items():
            of[x].append(pair)
        won = {min(pairs): x for x, pairs in of.items() if x not in taken}
        done.update(won)
        taken.update(won.values())
        n = digits + max(0, k - vault.SAME_LENGTH_ROUNDS)
        todo = {p: token(*p, f"#{k}", n) for p in todo if p not in won}
    return done


def test_full_types_wait_for_longer_tokens(spark, monkeypatch):
    pairs = [("PHONE", f"p{i}") for i in range(60)] + [("IP", f"i{i}") for i in range(9)] + [("ID", f"d{i}") for i in range(16)]
    df = spark.createDataFrame(pairs, "entity_type string, original string")
    df = df.unionAll(df.limit(5))  # a repeated row is one
    delta = df.select(C.token("entity_type", "original", "s", 1).alias("token"), "original", "entity_type")
    old = [("__MASKED_ip_0__", "x", "IP"), ("__MASKED_phone_1__", "y", "PHONE"), ("__MASKED_phone_07__", "z", "PHONE"), (None, "n", "IP")]
    sizes, decided = [], vault._decided
    monkeypatch.setattr(vault, "_decided", lambda todo, taken: sizes.append(todo.count()) or decided(todo, taken))
    rows = vault.resolve_collisions(stored(delta, "delta"), "s", spark.createDataFrame(old, vault.VAULT_SCHEMA), hex_len=1).collect()
    assert {(r.entity_type, r.original): r.token for r in rows} == rounds(pairs, [r[0] for r in old], "s", 1) and len(rows) == len(pairs)
    # phones take their 16 tokens in a few rounds; before, every loser was shuffled in all rounds
    assert sum(s >= 60 - 16 for s in sizes) < vault.SAME_LENGTH_ROUNDS


def test_rows_without_a_token_stay(spark):
    rows = [(None, "a", None), (None, "b", None), ("__MASKED_ip_1__", "a", "IP"), ("__MASKED_ip_1__", None, "IP")]
    delta = spark.createDataFrame(rows, vault.VAULT_SCHEMA)
    got = vault.resolve_collisions(delta, "s", hex_len=1).select(F.coalesce("token", F.lit("-")).alias("t"), "original").collect()
    assert sorted(str(r.original) for r in got if r.t == "-") == ["a", "b"]
    assert sorted(str(r.original) for r in got if r.t != "-") == ["None", "a"] and len({r.t for r in got}) == 3
