"""The audit log as hash chains: build, verify, export and restore."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import staged

#: What the first entry of a chain continues, the actor that entries name where none is given, the
#: embedder's algorithm, the operation and item of an attestation, and the tag of snapshots.
GENESIS = "pag:genesis"
ACTOR = {"agent_id": "memory-service", "attestation_level": "none", "model_id": None}
ALGORITHM, ATTEST, EMBEDDER, SCHEMA = "hashing-bow/blake2b8", "model-attest", "embedder", "pag/1"

ENTRY = "chain_id int, seq long, day int, op string, item_id string, detail string, agent_id string, model_id string, attestation_level string, payload string, content_hash string, prev_hash string, entry_hash string, sig string"


def canonical(value: dict) -> str:
    """JSON with sorted keys, no spaces, and characters beyond ASCII escaped."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def entry_of(prev: str, seq: int, day: int, op: str, item_id: str, detail: str, payload: str | None, key: bytes | None, actor: dict = ACTOR) -> dict:
    parsed = json.loads(payload) if payload is not None else None
    content = _sha(canonical({"op": op, "item_id": item_id, "detail": detail, "payload": parsed}))
    entry = _sha(prev + canonical({**actor, "seq": seq, "day": day, "op": op, "item_id": item_id, "detail": detail, "content_hash": content, "payload": parsed}))
    return {"seq": seq, "day": day, "op": op, "item_id": item_id, "detail": detail, **actor, "payload": payload, "content_hash": content, "prev_hash": prev, "entry_hash": entry, "sig": hmac.new(key, entry.encode(), hashlib.sha256).hexdigest() if key else None}


def attest(dim: int) -> dict:
    """Identity of the hashing embedder: a hash of its settings."""
    print_ = "cfg:" + _sha(canonical({"algorithm": ALGORITHM, "dim": dim}))[:32]
    return {"model": f"hashing-bow-{dim}", "grade": "config-hash", "fingerprint": print_}


def declared(model: str) -> dict:
    """Identity of a model that is known by its name only."""
    return {"model": model, "grade": "declared", "fingerprint": None}


def _given(audit: DataFrame, name: str, default: str | None) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in audit.columns else F.lit(default).cast("string")


def attested(audit: DataFrame, identity: dict, agent_id: str = ACTOR["agent_id"]) -> DataFrame:
    """audit with the model's attestation ahead of each chain, and with actors: those given in actor_id, model_id and
    attestation_level, else agent_id under the attested model."""
    actor = {"actor_id": (agent_id, "actor_id"), "model_id": (identity["model"], "model_id"), "attestation_level": (identity["grade"], "attestation_level")}
    rows = audit.select("chain_id", "seq", "day", "op", "item_id", "detail", _given(audit, "payload", None).alias("payload"), *[_given(audit, c, d).alias(n) for n, (d, c) in actor.items()])
    first = audit.groupBy("chain_id").agg((F.min("seq") - 1).alias("seq")).select(
        "chain_id", "seq", F.lit(0).alias("day"), F.lit(ATTEST).alias("op"), F.lit(EMBEDDER).alias("item_id"), F.lit(f"{identity['model']} ({identity['grade']})").alias("detail"),
        F.lit(canonical(identity)).alias("payload"), *[F.lit(d).alias(n) for n, (d, _) in actor.items()],
    )
    return first.unionByName(rows)


def build(audit: DataFrame, key: bytes | None = None, heads: DataFrame | None = None, by: Sequence[str] = ("chain_id",)) -> DataFrame:
    """ENTRY rows of audit (chain_id, seq, day, op, item_id, detail and, if there, payload, actor_id, model_id and
    attestation_level), numbered from 0 in each chain in the order of seq.

    A chain is serial by nature. Rows are dealt by chain and sorted, and a task reads them as a stream, so its memory
    holds a batch and not a chain; a single chain's time follows its length. heads (chain_id, last_seq, head) continues
    stored chains. by: what a chain is, if not all of a chain_id; see `segments`.

    Rows are dealt by a hash of the chain, not by its columns alone: rows that a union or a join has dealt by the columns
    would not be dealt again, and adaptive execution may merge or cut those partitions, and chains with them.
    """
    actor = [_given(audit, c, ACTOR[n]).alias(n) for n, c in (("agent_id", "actor_id"), ("model_id", "model_id"), ("attestation_level", "attestation_level"))]
    rows = audit.select("chain_id", "seq", "day", "op", "item_id", "detail", _given(audit, "payload", None).alias("payload"), *actor)
    rows = rows.join(heads.select("chain_id", "last_seq", "head"), "chain_id", "left") if heads is not None else rows.withColumns({"last_seq": F.lit(None).cast("long"), "head": F.lit(None).cast("string")})
    ordered = rows.repartition(*by, F.xxhash64(*by)).sortWithinPartitions(*by, "seq")
    schema = T._parse_datatype_string(ENTRY)

    def fold(batches):
        chain, prev, n = object(), GENESIS, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (own := tuple(r[c] for c in by)) != chain:
                    chain, prev, n = own, r["head"] or GENESIS, (r["last_seq"] if r["last_seq"] is not None else -1) + 1
                made = entry_of(prev, n, r["day"], r["op"], r["item_id"], r["detail"], r["payload"], key, {a: r[a] for a in ACTOR})
                prev, n = made["entry_hash"], n + 1
                out.append({"chain_id": r["chain_id"], **made})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return ordered.mapInArrow(fold, schema)


#: Parts of an entry's content and of its body, and what body hashes are of.
CONTENT = ["op", "item_id", "detail", "payload"]
BODY = [*ACTOR, "content_hash", "seq", "day", *CONTENT]


@F.pandas_udf(T.StringType())
def _escaped(rows: pd.DataFrame) -> pd.Series:
    """Canonical JSON of rows with a payload, or with characters that Spark's JSON writes another way."""
    whole = lambda n, v: None if v is None or v != v else json.loads(v) if n == "payload" else int(v) if n in ("seq", "day") else v
    return pd.Series([canonical({n: whole(n, v) for n, v in r.items()}) for r in rows.to_dict("records")])


def _plain() -> Column:
    """Rows whose JSON Spark writes as canonical JSON does: printable ASCII and no payload."""
    return F.concat_ws("", "op", "item_id", "detail", *ACTOR).rlike(r"\A[ -~]*\z") & F.col("payload").isNull()


def hashed(entries: DataFrame, apart: bool = True) -> DataFrame:
    """entries with _content and _entry, what content_hash and entry_hash should be. Rows that aren't plain go to
    Python; apart: only these, in a branch of their own, else all rows stay in their order and partition."""
    none = F.lit(None).cast("string").alias("payload")
    json_ = lambda names: F.to_json(F.struct(*[none if n == "payload" else F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})
    own = {"_content": F.sha2(json_(CONTENT), 256), "_entry": F.sha2(F.concat("prev_hash", json_(BODY)), 256)}
    odd = {"_content": F.sha2(_escaped(F.struct(*CONTENT)), 256), "_entry": F.sha2(F.concat("prev_hash", _escaped(F.struct(*BODY))), 256)}
    if not apart:
        return entries.withColumn("_plain", _plain()).withColumns({c: F.when(F.col("_plain"), own[c]).otherwise(odd[c]) for c in own}).drop("_plain")
    return entries.where(_plain()).withColumns(own).unionByName(entries.where(~_plain()).withColumns(odd))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC by two SHA-256s of padded keys."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


#: Numbers of a chain that are checked together, and signature failures that a report names.
SEGMENT, NAMED = 4096, 100

_SUMMARY = "chain_id long, segment long, n long, first long, first_prev string, first_prev_2 string, last long, last_n long, last_hash string, bad long, forged long, forged_at array<long>, content_ok boolean"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
_SUMMARY_ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in _SUMMARY.split(", "))])


def _segments(batches, genesis: str, length: int, named: int):
    """A row for each segment of sorted rows: what its ends are, and the first number that doesn't continue the one
    before, the segment's own first number apart, which waits for the segment before."""
    held: pa.Table | None = None
    done: dict | None = None

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_SUMMARY_ARROW)

    def fold(table: pa.Table) -> list[dict]:
        """Whole groups of one number each, in order."""
        nonlocal done
        chain, seq = table["chain_id"].to_numpy(zero_copy_only=False), table["seq"].to_numpy(zero_copy_only=False)
        segment = seq // length
        start = np.flatnonzero(np.concatenate([[True], (chain[1:] != chain[:-1]) | (seq[1:] != seq[:-1])]))
        size = np.diff(np.append(start, len(seq)))
        prev, entry = table["prev_hash"].to_pylist(), table["entry_hash"].to_pylist()
        fits, forged, content = (table[c].to_pylist() for c in ("fits", "forged", "content_fits"))
        closed = []
        for a, n in zip(start.tolist(), size.tolist()):
            own = (chain[a].item(), segment[a].item())
            at = seq[a].item()
            if done is None or (done["chain_id"], done["segment"]) != own:
                if done is not None:
                    closed.append(done)
                came = prev[a : a + n]
                done = {"chain_id": own[0], "segment": own[1], "n": 0, "first": at, "first_prev": came[0], "first_prev_2": next((p for p in came if p != came[0]), came[0]), "bad": None, "forged": 0, "forged_at": [], "content_ok": True}
                linked = at != 0 or all(p == genesis for p in came)
            else:
                linked = done["last"] == at - 1 and done["last_n"] == 1 and all(p == done["last_hash"] for p in prev[a : a + n])
            if done["bad"] is None and not (linked and all(fits[a : a + n])):
                done["bad"] = at
            if done["bad"] is None and (k := sum(forged[a : a + n])):
                done["forged"] += k
                done["forged_at"] += [at] * min(k, named - len(done["forged_at"]))
            done |= {"n": done["n"] + n, "last": at, "last_n": n, "last_hash": entry[a], "content_ok": done["content_ok"] and all(content[a : a + n])}
        return closed

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        # The last number of a batch may have a twin in the next one.
        chain, seq = table["chain_id"].to_numpy(zero_copy_only=False), table["seq"].to_numpy(zero_copy_only=False)
        odd = np.flatnonzero((chain != chain[-1]) | (seq != seq[-1]))
        cut = int(odd[-1]) + 1 if len(odd) else 0
        held = table.slice(cut)
        if cut and (closed := fold(table.slice(0, cut))):
            yield out(closed)
    if held is not None:
        closed = fold(held)
        yield out([*closed, done])


def verify(entries: DataFrame, key: bytes | None = None, ordered: bool = False) -> DataFrame:
    """A row for each chain: ok, length, broken_at (the first entry that doesn't continue the one before), signed,
    sig_failures before it (the first NAMED of them) and their number, and whether all content hashes fit.

    The log is shuffled once, by chain and segment of SEGMENT numbers, without its texts: a long chain is spread over
    tasks. A segment is read in order as a stream and leaves one row; a segment's first entry is held against the end
    of the segment before by a join of these rows. An entry without a predecessor, or with two, is broken. ordered:
    entries lie so already (each segment in one partition, by chain_id and seq), and aren't shuffled."""
    length, named = SEGMENT, NAMED
    forged = F.lit(False) if not key else ~F.coalesce(F.col("sig") == hmac_sha256(F.col("entry_hash"), key), F.lit(False))
    fits = F.coalesce(F.col("entry_hash") == F.col("_entry"), F.lit(False))
    judged = hashed(entries, apart=not ordered).select(F.col("chain_id").cast("long").alias("chain_id"), "seq", "prev_hash", "entry_hash", fits.alias("fits"), forged.alias("forged"), F.coalesce(F.col("content_hash") == F.col("_content"), F.lit(False)).alias("content_fits"))
    if not ordered:
        judged = judged.withColumn("_segment", F.floor(F.col("seq") / SEGMENT)).repartition("chain_id", "_segment").sortWithinPartitions("chain_id", "seq").drop("_segment")
    parts = staged(judged.mapInArrow(lambda batches: _segments(batches, GENESIS, length, named), _SUMMARY), "segments")
    ends = parts.select("chain_id", (F.col("segment") + 1).alias("segment"), F.col("last").alias("_last"), F.col("last_n").alias("_last_n"), F.col("last_hash").alias("_hash"))
    joined = parts.join(ends, ["chain_id", "segment"], "left")
    seam = (F.col("first") == 0) | F.coalesce((F.col("_last") == F.col("first") - 1) & (F.col("_last_n") == 1) & (F.col("first_prev") == F.col("_hash")) & (F.col("first_prev_2") == F.col("_hash")), F.lit(False))
    joined = joined.withColumn("at", F.when(~seam, F.col("first")).otherwise(F.col("bad"))).withColumn("k", F.when(seam, F.col("forged")).otherwise(0)).withColumn("ks", F.when(seam, F.col("forged_at")).otherwise(F.array().cast("array<bigint>")))
    broken = joined.groupBy("chain_id").agg(F.sum("n").alias("length"), F.min("at").alias("broken_at"), F.min("content_ok").alias("content_ok"))
    before = F.col("broken_at").isNull() | (F.col("first") <= F.col("broken_at"))
    some = joined.where("k > 0").join(broken.select("chain_id", "broken_at"), "chain_id").where(before)
    # Segments beyond the first that name NAMED failures add nothing to the list.
    first = Window.partitionBy("chain_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("_named", F.coalesce(F.sum("k").over(first), F.lit(0)))
    failures = some.groupBy("chain_id").agg(F.sum("k").alias("n_sig_failures"), F.slice(F.array_sort(F.flatten(F.collect_list(F.when(F.col("_named") < NAMED, F.col("ks"))))), 1, NAMED).alias("sig_failures"))
    report = broken.join(failures, "chain_id", "left")
    none = F.coalesce("n_sig_failures", F.lit(0))
    return report.select(F.col("chain_id").cast(entries.schema["chain_id"].dataType).alias("chain_id"), (F.col("broken_at").isNull() & (none == 0)).alias("ok"), "length", "broken_at", F.lit(bool(key)).alias("signed"), F.coalesce("sig_failures", F.array().cast("array<bigint>")).alias("sig_failures"), none.alias("n_sig_failures"), "content_ok")


def heads(entries: DataFrame) -> DataFrame:
    return entries.groupBy("chain_id").agg(F.max("seq").alias("last_seq"), F.max_by("entry_hash", "seq").alias("head"), F.count("*").alias("length"))


#: The operation of a summary's entries, and days that a chain can have, for numbers of segments.
SEGMENT_OP, DAYS = "segment", 1 << 20


def segments(audit: DataFrame, key: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, summary): a chain for each chain_id and day, and one for each chain_id above them, with an entry for
    each day that names its segment's length and head. A chain of many days is built by many tasks; the summary has a
    row a day. Days are from 0 to before DAYS, entries of a segment are numbered from 0."""
    entries = staged(build(audit, key, by=("chain_id", "day")), "segment-entries")
    ends = entries.groupBy("chain_id", "day").agg(F.max_by("entry_hash", "seq").alias("head"), F.count("*").alias("n"))
    named = ends.select("chain_id", F.col("day").cast("long").alias("seq"), "day", F.lit(SEGMENT_OP).alias("op"), F.concat_ws("/", F.col("chain_id").cast("string"), F.col("day").cast("string")).alias("item_id"), _named(F.col("n"), F.col("head")).alias("detail"))
    return entries, staged(build(named, key), "segment-summary")


def _named(n: Column, head: Column) -> Column:
    return F.concat_ws(":", n.cast("string"), head)


def verify_segments(entries: DataFrame, summary: DataFrame, key: bytes | None = None) -> DataFrame:
    """A row for each chain_id: ok, days, length, broken_day (the first day whose segment doesn't verify, or isn't what
    the summary names) and whether the summary verifies."""
    number = F.col("chain_id").cast("long") * DAYS + F.col("day")
    ends = entries.groupBy("chain_id", "day").agg(F.max_by("entry_hash", "seq").alias("head"), F.count("*").alias("n"), number.alias("_c"))
    report = verify(entries.withColumn("chain_id", number), key).select(F.col("chain_id").alias("_c"), F.col("ok").alias("_ok"))
    named = summary.where(F.col("op") == SEGMENT_OP).select("chain_id", "day", "detail")
    days = ends.join(report, "_c").join(named, ["chain_id", "day"], "full")
    fits = F.coalesce(F.col("_ok") & (F.col("detail") == _named(F.col("n"), F.col("head"))), F.lit(False))
    found = days.groupBy("chain_id").agg(F.count("*").alias("days"), F.sum(F.coalesce("n", F.lit(0))).alias("length"), F.min(F.when(~fits, F.col("day"))).alias("broken_day"))
    above = verify(summary, key).select("chain_id", F.col("ok").alias("summary_ok"))
    found = found.join(above, "chain_id", "left").withColumn("summary_ok", F.coalesce("summary_ok", F.lit(False)))
    return found.select("chain_id", (F.col("broken_day").isNull() & F.col("summary_ok")).alias("ok"), "days", "length", "broken_day", "summary_ok")


def proof(entries: DataFrame, summary: DataFrame, chain_id: int, day: int, seq: int) -> dict:
    """That an entry is in its chain: its segment's entries from it on, and the summary's from its day on."""
    rows = lambda df: [r.asDict() for r in df.where(F.col("chain_id") == chain_id).orderBy("seq").collect()]
    return {"segment": rows(entries.where((F.col("day") == day) & (F.col("seq") >= seq))), "summary": rows(summary.where(F.col("day") >= day))}


def proven(shown: dict, head: str, key: bytes | None = None) -> bool:
    """Whether a proof leads from its first entry to the summary's head, which the reader knows and trusts."""

    def end(rows: list[dict]) -> str | None:
        prev = rows[0]["prev_hash"] if rows else None
        for r in rows:
            made = entry_of(prev, r["seq"], r["day"], r["op"], r["item_id"], r["detail"], r["payload"], key, {a: r[a] for a in ACTOR})
            if r["prev_hash"] != prev or any(made[c] != r[c] for c in ("content_hash", "entry_hash", *(["sig"] if key else []))):
                return None
            prev = r["entry_hash"]
        return prev

    segment, summary = shown["segment"], shown["summary"]
    top = end(segment)
    if top is None or end(summary) != head:
        return False
    first = segment[0]
    return summary[0]["op"] == SEGMENT_OP and summary[0]["item_id"] == f"{first['chain_id']}/{first['day']}" and summary[0]["detail"] == f"{segment[-1]['seq'] + 1}:{top}"


def export(entries: DataFrame, path: str) -> None:
    """A snapshot: the entries, and a manifest with each chain's head."""
    entries.write.mode("overwrite").json(f"{path}/entries")
    heads(entries).withColumn("schema", F.lit(SCHEMA)).write.mode("overwrite").json(f"{path}/manifest")


def restore(spark: SparkSession, path: str, key: bytes | None = None) -> DataFrame:
    """A snapshot's entries; refused if a chain doesn't verify or its head isn't the manifest's (a null head passes)."""
    entries = spark.read.schema(ENTRY).json(f"{path}/entries")
    manifest = spark.read.schema("chain_id int, head string").json(f"{path}/manifest")
    now = verify(entries, key).join(heads(entries).select("chain_id", F.col("head").alias("found")), "chain_id").join(manifest, "chain_id", "full")
    bad = now.where("not coalesce(ok, false) or (head is not null and head <> coalesce(found, ''))").select("chain_id").limit(10).collect()
    if bad:
        raise ValueError(f"snapshot refused: chains {sorted(r.chain_id for r in bad)}")
    return entries
