"""Repair of damaged conversations: the cheapest edits that give alternating turns.

A conversation's rows in turn order become a sequence of role initials that must
read ``(s?(ua)+)?``. Each row is kept (K, cost 0), given the role that fits (R, 3) or
deleted (D, 4); empty turns are inserted (I, 3). Blank rows and repeats must go;
a truncated row that stays adds 3. Among the cheapest edits the one whose initials
read least in ASCII is taken.

Faults are flagged by windows; then ``aggregate()`` folds the sorted array of a
conversation's turns and carries four ``(cost, audit)`` structs, one for each
state of the pattern: nothing yet, after s, after u, after a. A state takes the
``least`` of the ways into it. Ties are settled in each state alone, which is safe:
of two audits of equal cost that lead to one state, neither begins with the other,
as what is longer has inserted more.

A conversation longer than ``CHUNK`` rows is never one array. Its rows are dealt
into ranges of their order and cut into chunks; a chunk is folded from each of the
four states, which gives a table of 4 x 4 structs, and neighbouring tables are
joined, ``FAN`` at a time, until one is left. The states at the cuts say which
part of each table was used. Only the texts' SHA-256, which can't be joined
from parts, reads the repaired text of a conversation as one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathework.llm.common import few
from lathework.session import materialize

KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
#: Rows that one fold takes at most, tables joined at once, rows of a range of a long conversation.
CHUNK, FAN, RANGE = 256, 64, 20_000
#: A cost that nothing reaches.
NEVER = 1 << 50
#: ASCII white space.
WHITE = " \t\n\x0b\x0c\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(rows: DataFrame) -> DataFrame:
    """The rows after the damage that ``crc32(conv_id:turn) % 20`` says; dropped ones stay with 0 ``copies``.

    Nulls read as one space in the key, the role and the text. ``trimmed`` is the text without white space at its end.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    own = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    own = own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))
    return own.withColumn("trimmed", F.rtrim("text", F.lit(WHITE)))


def flagged(rows: DataFrame) -> DataFrame:
    """Rows with their faults, by windows over each (conversation, piece): ``x`` holds what the fold reads.

    A row of n copies is one row and n - 1 repeats. Order is by turn, nulls first, then role, then the text's SHA-256.
    """
    own = Window.partitionBy("conv_id", "piece")
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    first = F.substring("role", 1, 1)
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("initial", first)
    # dropped rows are last, so that they are no row's neighbour
    rows = rows.withColumn("gone", F.col("copies") == 0)
    seat = own.orderBy("gone", *order)
    rows = rows.withColumn("place", F.row_number().over(seat)).withColumn("before", F.lag("initial").over(seat))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "piece", "role", "digest").orderBy("gone", "place")))


def packed(rows: DataFrame) -> DataFrame:
    """The rows of ``flagged`` with ``again`` (a repeat of an earlier row) as one struct ``x``, and their counts."""
    blank, gone, again = F.col("trimmed") == "", F.col("gone"), F.col("again")
    n = F.col("copies")
    cut = ~blank & ~again & ~F.substring(F.col("trimmed"), -1, 1).isin(".", "!", "?")
    item = F.struct("place", "turn", "role", "text", "initial", (blank | again).alias("forced"), F.when(cut, TRUNCATED).otherwise(0).alias("extra"), "copies")
    zero = lambda c: F.when(gone, 0).otherwise(c).cast("long")
    return rows.select(
        "conv_id", "piece", "place", F.when(~gone, item).alias("x"),
        zero(F.when(blank, n).otherwise(0)).alias("blank"),
        zero(F.when(blank, 0).when(again, n).otherwise(n - 1)).alias("duplicate"),
        zero(cut.cast("int")).alias("truncated"),
        zero(n - 1 + broken("before", "initial")).alias("illegal"),
    )


def broken(before: Column | str, after: Column | str) -> Column:
    """1 if the two initials may not be neighbours, 0 if they may or there is none before."""
    return F.coalesce((~F.concat(before, after).isin("su", "ua", "au")).cast("int"), F.lit(0))


def _add(state: Column, cost: int, edits: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(edits)).alias("audit"))


def _start(state: int) -> Column:
    return F.struct(*[F.struct(F.lit(0 if k == state else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).alias(f"s{k}") for k in range(4)])


def _insert(s: Column) -> Column:
    """The states after inserting as many turns as pay: one from anywhere to u or from u to a, or both."""
    after_u = F.least(s["s2"], *[_add(s[k], INSERT, "I") for k in ("s0", "s1", "s3")])
    after_a = F.least(s["s3"], _add(s["s2"], INSERT, "I"), *[_add(s[k], 2 * INSERT, "II") for k in ("s0", "s1")])
    return F.struct(s["s0"].alias("s0"), s["s1"].alias("s1"), after_u.alias("s2"), after_a.alias("s3"))


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _row(s: Column, x: Column) -> Column:
    """The states after a row, from states after inserts. Repeats of a row that may stay are deleted after it."""
    copies = x["copies"]
    deleted = lambda c: F.struct((c["cost"] + DELETE * copies).alias("cost"), F.concat(c["audit"], F.repeat(F.lit("D"), copies)).alias("audit"))

    def stays(c: Column, edit: str, initial: str) -> Column:
        able = ~x["forced"] if edit == "R" else ~x["forced"] & (x["initial"] == initial)
        own = (KEEP if edit == "K" else REROLE) + x["extra"] + DELETE * (copies - 1)
        return F.struct(F.when(able, c["cost"] + own).otherwise(NEVER).alias("cost"), F.concat(c["audit"], F.lit(edit), F.repeat(F.lit("D"), copies - 1)).alias("audit"))

    return F.struct(
        deleted(s["s0"]).alias("s0"),
        F.least(deleted(s["s1"]), stays(s["s0"], "K", "s")).alias("s1"),
        F.least(deleted(s["s2"]), *[stays(s[k], edit, "u") for k in ("s0", "s1", "s3") for edit in "KR"]).alias("s2"),
        F.least(deleted(s["s3"]), *[stays(s["s2"], edit, "a") for edit in "KR"]).alias("s3"),
    )


def fold(turns: Column, start: int = 0) -> Column:
    """Four structs ``s0`` to ``s3``: the cheapest edits of an array of turns into each state, from state ``start``."""
    return F.aggregate(turns, _start(start), lambda s, x: _with(_insert(s), lambda t: _row(t, x)))


def best(states: Column) -> Column:
    """The cheapest accepted ``(cost, audit)`` after the last row."""
    return _with(_insert(states), lambda t: F.least(t["s0"], t["s3"]))


def apply_edits(turns: Column, audit: Column, after_u: Column | None = None) -> Column:
    """The repaired ``role:text`` lines of turns by the edits of an audit; ``after_u``: the line before the first is a user's."""
    start = F.struct((F.lit(False) if after_u is None else after_u).alias("b"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("lines"))

    def step(rows: Column, s: Column, e: Column) -> Column:
        x = F.get(rows, s["at"])
        other = F.when(s["b"], "assistant").otherwise("user")
        line = F.concat(F.when(e == "K", x["role"]).otherwise(other), F.lit(":"), F.when(e == "I", "").otherwise(x["text"]))
        return F.struct(
            F.when(e == "D", s["b"]).when(e == "K", x["initial"] == "u").otherwise(~s["b"]).alias("b"),
            (s["at"] + (e != "I").cast("int")).alias("at"),
            F.when(e == "D", s["lines"]).otherwise(F.concat(s["lines"], F.array(line))).alias("lines"),
        )

    edits = F.filter(F.split(audit, ""), lambda e: e != "")
    copied = F.flatten(F.transform(turns, lambda x: F.array_repeat(x, x["copies"])))
    return _with(copied, lambda rows: F.aggregate(edits, start, lambda s, e: step(rows, s, e), lambda s: s["lines"]))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that are one array each."""
    own = packed(flagged(rows.withColumn("piece", F.lit(0))).withColumn("again", F.col("nth") > 1))
    one = own.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("x")).alias("turns"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    seen = F.filter(F.transform("turns", lambda x: x["turn"]), lambda t: t.isNotNull())
    gaps = _with(seen, lambda t: F.array_max(t) - F.array_min(t) + 1 - F.size(F.array_distinct(t)))
    one = one.withColumn("best", best(fold(F.col("turns")))).withColumn("gaps", F.coalesce(gaps, F.lit(0)).cast("long"))
    lines = apply_edits(F.col("turns"), F.col("best.audit"))
    return one.select("conv_id", *COUNTS[:-1], F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


def _chunks(rows: DataFrame, total: int, chunk: int, per_range: int) -> DataFrame:
    """Rows of long conversations as chunks in order: ``turns``, counts, and the ``table`` of folds from each state."""
    rows = rows.withColumn("digest", F.sha2("text", 256))
    rows = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"), F.first("trimmed").alias("trimmed"), F.sum("copies").cast("int").alias("copies"))
    rows = rows.repartitionByRange(max(1, -(-total // per_range)), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest").withColumn("piece", F.spark_partition_id())
    rows = materialize(flagged(materialize(rows, "ranges")), "flagged")
    # a text that is new in its range may have been in one before
    across = Window.partitionBy("conv_id", "role", "digest").orderBy("piece")
    new = rows.where("nth = 1").withColumn("again", F.row_number().over(across) > 1)
    own = packed(new.unionByName(rows.where("nth > 1").withColumn("again", F.lit(True)))).withColumn("chunk", F.floor((F.col("place") - 1) / chunk))
    found = own.groupBy("conv_id", "piece", "chunk").agg(F.sort_array(F.collect_list("x")).alias("turns"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    folds = found.withColumn("folds", F.array(*[fold(F.col("turns"), k) for k in range(4)]))
    with_path = lambda f: F.struct(*[F.struct(f[f"s{k}"]["cost"].alias("cost"), f[f"s{k}"]["audit"].alias("audit"), F.lit(str(k)).alias("path")).alias(f"s{k}") for k in range(4)])
    found = materialize(folds.withColumn("table", F.transform("folds", with_path)).drop("folds"), "chunks")
    # numbers of chunks, and pairs of neighbours in different ranges, from a slim frame: a row for each chunk
    slim = found.select("conv_id", "piece", "chunk", F.col("turns")[0]["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last"))
    seat = Window.partitionBy("conv_id").orderBy("piece", "chunk")
    slim = slim.withColumn("n", F.row_number().over(seat) - 1).withColumn("torn", F.when(F.col("chunk") == 0, broken(F.lag("last").over(seat), "first")).otherwise(0))
    slim = slim.select(F.col("conv_id").alias("_id"), F.col("piece").alias("_piece"), F.col("chunk").alias("_chunk"), "n", "torn")
    same = F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("piece") == F.col("_piece")) & (F.col("chunk") == F.col("_chunk"))
    return materialize(found.join(slim, same).withColumn("illegal", F.col("illegal") + F.col("torn")).drop("_id", "_piece", "_chunk", "torn", "piece", "chunk"), "numbered")


def _join(tables: Column) -> Column:
    """One table for an array of neighbouring tables."""
    way = lambda a, b: F.struct(F.least(F.lit(NEVER), a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["path"], b["path"]).alias("path"))
    after = lambda s, t: F.struct(*[F.least(*[way(s[f"s{k}"], t[k][f"s{j}"]) for k in range(4)]).alias(f"s{j}") for j in range(4)])
    rest = F.slice(tables, 2, F.greatest(F.size(tables) - 1, F.lit(0)))
    return F.aggregate(rest, tables[0], lambda own, t: F.transform(own, lambda s: after(s, t)))


def _long(rows: DataFrame, total: int, chunk: int = CHUNK, fan: int = FAN, per_range: int = RANGE) -> DataFrame:
    """Conversations of any length, in chunks."""
    rows = rows.where("copies > 0")
    chunks = _chunks(rows, total, chunk, per_range)
    level = chunks.select("conv_id", "n", "table")
    most = level.agg(F.max("n")).first()[0]
    while most:
        level = level.groupBy("conv_id", F.floor(F.col("n") / fan).cast("int").alias("n")).agg(F.sort_array(F.collect_list(F.struct("n", "table"))).alias("own"))
        level = materialize(level.select("conv_id", "n", _join(F.transform("own", lambda x: x["table"])).alias("table")), "joined")
        most //= fan
    ends = F.col("table")[0]
    close = lambda k, cost, edits: F.struct((ends[f"s{k}"]["cost"] + cost).alias("cost"), F.concat(ends[f"s{k}"]["audit"], F.lit(edits)).alias("audit"), ends[f"s{k}"]["path"].alias("path"))
    done = level.select("conv_id", F.least(close(0, 0, ""), close(3, 0, ""), close(2, INSERT, "I"), close(1, 2 * INSERT, "II")).alias("best"))
    done = materialize(done, "edits")

    states = F.split("best.path", "")
    path = done.select(F.col("conv_id").alias("_id"), F.posexplode(F.filter(states, lambda s: s != "")).alias("_n", "_end"), F.concat(F.lit("0"), "best.path").alias("_path"))
    path = path.select("_id", "_n", F.col("_end").cast("int").alias("_end"), F.expr("cast(substring(_path, _n + 1, 1) as int)").alias("_start"))
    used = chunks.join(path, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("n") == F.col("_n")))
    way = F.get("table", F.col("_start"))
    audit = F.coalesce(*[F.when(F.col("_end") == k, way[f"s{k}"]["audit"]) for k in range(4)])
    text = F.array_join(apply_edits(F.col("turns"), audit, F.col("_start") == 2), "\n")
    parts = used.select("conv_id", "n", text.alias("lines"), *COUNTS[1:-1]).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("lines") != "", F.struct("n", "lines")))).alias("parts"), *[F.sum(c).alias(c) for c in COUNTS[1:-1]]
    )
    turns = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    turns = turns.select(F.col("conv_id").alias("_t"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))
    done = done.withColumnRenamed("conv_id", "_d")
    out = parts.join(turns, F.col("conv_id").eqNullSafe(F.col("_t"))).join(done, F.col("conv_id").eqNullSafe(F.col("_d")))
    end = F.substring("best.path", -1, 1)
    closing = F.when(end == "1", F.array(F.lit("user:"), F.lit("assistant:"))).when(end == "2", F.array(F.lit("assistant:"))).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.transform("parts", lambda p: p["lines"]), closing), "\n")
    return out.select("conv_id", *COUNTS[:-1], F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.sha2(whole, 256).alias("repaired_sha256"))


def repair(rows: DataFrame, chunk: int = CHUNK, fan: int = FAN, per_range: int = RANGE) -> DataFrame:
    """Per ``conv_id`` of damaged ``rows`` (as of ``damage``): faults, cost and audit of the cheapest repair, SHA-256 of the repaired lines.

    A null ``conv_id`` is a conversation of its own; null turns come first; rows of
    one turn are ordered by role and the text's SHA-256. A conversation whose rows
    were all dropped has zeros, an empty audit and the hash of the empty string.
    ``gaps`` is 0 where no turn is known.
    """
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"))
    long = materialize(sizes.where(F.col("n") > chunk), "long_conversations")
    total = long.agg(F.sum("n")).first()[0]
    if not total:
        return _short(rows)
    ids = long.select(F.col("conv_id").alias("_id"))
    ids = F.broadcast(ids) if few(ids) else ids
    same = F.col("conv_id").eqNullSafe(F.col("_id"))
    return _short(rows.join(ids, same, "left_anti")).unionByName(_long(rows.join(ids, same, "left_semi"), total, chunk, fan, per_range))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The same in DuckDB: CRC-32 by a table made of its polynomial, the fold and the edits as recursions.
OP12_SQL = r"""
with recursive poly as (
  select list(list_reduce(range(8), lambda c, _: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end), n) order by n) as t from range(256) r(n)
), conv as (
  select row_number() over () as cid, conv_id from (select distinct conv_id from conversations)
), raw as (
  select cid, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(c.conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key
  from conversations c join conv on c.conv_id is not distinct from conv.conv_id
), coded as (
  select cid, turn, role, text, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ord(x)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as kind from raw, poly
), hurt as (
  select cid, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) as copy
  from coded where kind <> 0
), seated as (
  select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, left(role, 1) as i,
    row_number() over (partition by cid order by turn nulls first, role, sha256(text), copy) as n
  from hurt
), faults as (
  select *, case when body = '' then 'b' when row_number() over (partition by cid, role, text order by n) > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault,
    lag(i) over (partition by cid order by n) as before
  from seated
), fold as (
  select cid, 0::bigint as n, {'c': 0, 'a': ''} as s0, {'c': 1000000000, 'a': ''} as s1, {'c': 1000000000, 'a': ''} as s2, {'c': 1000000000, 'a': ''} as s3 from conv
  union all
  select cid, n,
    {'c': s0.c + 4, 'a': s0.a || 'D'},
    least({'c': s1.c + 4, 'a': s1.a || 'D'}, {'c': case when ok and i = 's' then s0.c + extra else 1000000000 end, 'a': s0.a || 'K'}),
    least({'c': s2.c + 4, 'a': s2.a || 'D'}, {'c': case when ok and i = 'u' then s0.c + extra else 1000000000 end, 'a': s0.a || 'K'}, {'c': case when ok and i = 'u' then s1.c + extra else 1000000000 end, 'a': s1.a || 'K'},
      {'c': case when ok and i = 'u' then s3.c + extra else 1000000000 end, 'a': s3.a || 'K'}, {'c': case when ok then s0.c + extra + 3 else 1000000000 end, 'a': s0.a || 'R'},
      {'c': case when ok then s1.c + extra + 3 else 1000000000 end, 'a': s1.a || 'R'}, {'c': case when ok then s3.c + extra + 3 else 1000000000 end, 'a': s3.a || 'R'}),
    least({'c': s3.c + 4, 'a': s3.a || 'D'}, {'c': case when ok and i = 'a' then s2.c + extra else 1000000000 end, 'a': s2.a || 'K'}, {'c': case when ok then s2.c + extra + 3 else 1000000000 end, 'a': s2.a || 'R'})
  from (
    select f.cid, x.n, x.i, x.fault not in ('b', 'd') as ok, case x.fault when 't' then 3 else 0 end as extra, s0, s1,
      least(s2, {'c': s0.c + 3, 'a': s0.a || 'I'}, {'c': s1.c + 3, 'a': s1.a || 'I'}, {'c': s3.c + 3, 'a': s3.a || 'I'}) as s2,
      least(s3, {'c': s2.c + 3, 'a': s2.a || 'I'}, {'c': s0.c + 6, 'a': s0.a || 'II'}, {'c': s1.c + 6, 'a': s1.a || 'II'}) as s3
    from fold f join faults x on f.cid = x.cid and x.n = f.n + 1
  )
), best as (
  select cid, least(s0, s3, {'c': s2.c + 3, 'a': s2.a || 'I'}, {'c': s1.c + 6, 'a': s1.a || 'II'}) as b from fold qualify row_number() over (partition by cid order by n desc) = 1
), edits as (
  select cid, 0::bigint as k, 0::bigint as n, false as u, b.a as audit, [] :: varchar[] as lines from best
  union all
  select e.cid, e.k + 1, e.n + (e.e <> 'I')::int, case e.e when 'D' then u when 'K' then x.i = 'u' else not u end, audit,
    case e.e when 'D' then lines else list_append(lines, case when e.e = 'K' then x.role when u then 'assistant' else 'user' end || ':' || case e.e when 'I' then '' else x.text end) end
  from (select *, substr(audit, k + 1, 1) as e from edits where k < length(audit)) e left join seated x on e.cid = x.cid and x.n = e.n + 1
), repaired as (
  select cid, sha256(array_to_string(lines, chr(10))) as repaired_sha256 from edits where k = length(audit)
), counted as (
  select cid, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal, max(turn) - min(turn) + 1 - count(distinct turn) as gaps
  from faults group by 1
)
select conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(b.c as bigint) as cost, b.a as audit, repaired_sha256
from conv join best using (cid) join repaired using (cid) left join counted using (cid)
"""
