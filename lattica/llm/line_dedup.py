"""Line dedup by a segment-partition edit join; DataFrame functions only."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import carried, cut, cut_bucketed, freed, parts_for, table, uncarried

#: Lines within this edit distance of an earlier line are dropped, if they have MIN_CHARS characters.
MAX_EDITS, MIN_CHARS = 2, 24
#: Characters, the frequent ones first, that counts tell apart; all others are alike.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz0123456789"
#: Numbers in the count filter, of 8 bits each.
COUNTS = 8
#: Lines that share a key are all compared up to this number; those of larger groups get narrower keys.
GROUP = 64
#: Megabytes of text in one bucket of the table of marked texts.
BUCKET_MB = 24
#: Place of a line: document id, a mark of its text, line number; documents without an id come last.
LAST = 2**63 - 1


def place(doc_id: Column, mark: Column, pos: Column) -> Column:
    """One decimal that orders lines, so that the least is kept by a hash aggregate."""
    wide = lambda x: x.cast("decimal(38,0)")
    high = F.coalesce(wide(doc_id), wide(F.lit(LAST))) * F.lit(2**30).cast("decimal(10,0)") + mark
    return wide(wide(high) * F.lit(2**31).cast("decimal(10,0)") + pos)


def _unplace(at: Column) -> tuple[Column, Column, Column]:
    """pos, mark and document id of a place."""
    pos = F.pmod(at, F.lit(2**31).cast("decimal(38,0)")).cast("int")
    high = ((at - pos) / F.lit(2**31).cast("decimal(10,0)")).cast("decimal(38,0)")
    mark = F.pmod(high, F.lit(2**30).cast("decimal(38,0)")).cast("int")
    return pos, mark, ((high - mark) / F.lit(2**30).cast("decimal(10,0)")).cast("long")


def letter_counts(line: Column) -> Column:
    """Counts of the characters of COUNTS classes of LETTERS, modulo 256, in one long."""
    out = F.lit(0).cast("long")
    for i in range(COUNTS):
        n = F.octet_length(line) - F.octet_length(F.translate(line, LETTERS[i::COUNTS], ""))
        out = out.bitwiseOR(F.shiftleft((n % 256).cast("long"), 8 * i))
    return out


def counts_near(a: Column, b: Column, edits: int) -> Column:
    """True unless the counts alone show more than edits edits (an edit changes two counts at most)."""
    far = F.lit(0)
    for i in range(COUNTS):
        d = F.abs(F.shiftrightunsigned(a, 8 * i).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(b, 8 * i).bitwiseAND(F.lit(255)))
        far = far + F.least(d, 256 - d)
    return far <= 2 * edits


def _probes(edits: int) -> list[tuple[int, int, int]]:
    """(d, i, o): segment i of a line shorter by d is sought o characters after its own start.

    A substring can match it only at the starts that both the edits before it (at most i - 1) and those
    after it (at most edits + 1 - i) allow.  (0, i, 0) are a line's own segments, by which it is found.
    """
    return [(d, i, o) for d in range(edits + 1) for i in range(1, edits + 2) for o in range(max(1 - i, d - (edits + 1 - i)), min(i - 1, d + (edits + 1 - i)) + 1)]


def segment_keys(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """key, v of lines(line, n): a hash of length, segment number and content, and line_id + 1 for a line's own segments,
    line_id for those that it seeks.

    The probes are rows, so one short expression makes every key.
    """
    parts = edits + 1
    probes = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(o).alias("o")) for d, i, o in _probes(edits)))
    # where characters are bytes, a piece is found without counting characters
    x = lines.select(line_id(F.col("line")).alias("id"), "line", F.when(F.octet_length("line") == F.col("n"), F.col("line").cast("binary")).alias("raw"), "n", F.explode(probes).alias("p"))
    i, shorter = F.col("p.i"), F.col("n") - F.col("p.d")
    base, extra = F.floor(shorter / parts).cast("int"), shorter % parts
    at = (i - 1) * base + F.greatest(F.lit(0), i - 1 - parts + extra) + F.col("p.o")  # later segments are longer
    x = x.select("id", "line", "raw", "n", i.alias("i"), shorter.alias("shorter"), at.alias("at"), (base + F.when(parts - i < extra, 1).otherwise(0)).alias("size"), ((F.col("p.d") == 0) & (F.col("p.o") == 0)).cast("long").alias("own"))
    x = x.filter((F.col("shorter") >= least) & (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))
    piece = F.when(F.col("raw").isNotNull(), F.substring("raw", F.col("at") + 1, F.col("size"))).otherwise(F.substring("line", F.col("at") + 1, F.col("size")).cast("binary"))
    return x.select(F.xxhash64("shorter", "i", piece).alias("key"), (F.col("id") + F.col("own")).alias("v"))


def line_id(line: Column) -> Column:
    """An even 64-bit hash of a line."""
    return F.shiftleft(F.xxhash64(line), 1)


def _own(v: Column) -> Column:
    return v.bitwiseAND(F.lit(1).cast("long"))


def _id(v: Column) -> Column:
    return v - _own(v)


def shares(edits: int) -> list[tuple[int, ...]]:
    """The ways to share edits edits out to the free parts of a line, in order; all to one part first."""
    return [(edits,)] + [(n, *more) for n in range(edits - 1, 0, -1) for more in shares(edits - n)]


def _narrower(edits: int) -> list[tuple[int, list[tuple[int, int, int | None]]]]:
    """The ways to narrow a free part with up to edits edits, cut into 2 * edits segments, to edits of them: number of the choice, and
    its runs of segments (first, end, by how much the line's run is longer; None: what is left of the whole difference).

    Edits touch as many segments at most, and a choice can be found in which a run of r segments has up to r of them.
    """
    out = []
    for number, chosen in enumerate(itertools.combinations(range(2 * edits), edits)):
        firsts = [x for x in chosen if x - 1 not in chosen]
        runs = [(x, next(y for y in range(x + 1, 2 * edits + 1) if y not in chosen)) for x in firsts]
        for gains in itertools.product(*(range(x - y, y - x + 1) for x, y in runs[:-1])):
            out.append((number, [(*run, gain) for run, gain in zip(runs, (*gains, None), strict=True)]))
    return out


def _ways(share: tuple[int, ...], edits: int) -> Column:
    """Each way to narrow all parts that edits are shared out to, as a constant.  The runs of each part are in order."""
    out = []
    for chosen in itertools.product(*map(_narrower, share)):
        runs, to, loses = [], [], 0
        for j, (k, (_, of)) in enumerate(zip(share, chosen, strict=True)):
            for first, end, gain in of:
                loses = loses or gain or 0
                to.append(end - first)
                run = {"part": j, "cut": 2 * k, "first": first, "end": end, "gain": gain, "opens": first == of[0][0], "closes": gain is None}
                runs.append(F.struct(*(F.lit(x).cast("boolean" if isinstance(x, bool) else "int").alias(c) for c, x in run.items())))
        # of two lines of one size and less than four edits, one has the gain first
        fields = {"number": F.lit(",".join(str(number) for number, _ in chosen)), "share": F.lit(shares(edits).index(tuple(to))), "both": F.lit(edits > 3 or loses >= 0), "runs": F.array(*runs)}
        out.append(F.struct(*(c.alias(name) for name, c in fields.items())))
    return F.array(*out)


def whole_lines(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """key, v, n, counts, share, parts, near of lines(id, n, counts): each line as one free part, once for each length that is sought."""
    x = lines.select("id", "n", "counts", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("more")).filter(F.col("n") - F.col("more") >= least)
    part = F.struct(F.lit(0).alias("at"), F.col("n").alias("size"), F.col("more").alias("more"), F.col("id").alias("mark"))
    v = F.col("id") + (F.col("more") == 0).cast("long")
    return x.select((F.col("n") - F.col("more")).cast("long").alias("key"), v.alias("v"), "n", "counts", F.lit(0).alias("share"), F.array(part).alias("parts"), F.lit(False).alias("near"))


def narrowed(rows: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """rows(key, v, n, counts, share, parts, near) with narrower free parts and, in the keys, what is left outside them.

    Lines of one key are equal outside their free parts.  Two that differ there by edits edits, shared out to the
    parts in any way that `share` names, have such a new key in common.
    """
    found = rows.withColumn("id", _id(F.col("v"))).join(texts.select("id", "line"), "id")
    line, own, ways = F.col("line"), _own(F.col("v")) == 1, F.lit(None)
    for i, share in enumerate(shares(edits)):
        ways = F.when(F.col("share") == i, _ways(share, edits)).otherwise(ways)

    def step(s: Column, run: Column) -> Column:
        part = F.get(F.col("parts"), run["part"])
        at, whole = part["at"], part["size"] - part["more"]
        edge = lambda x: F.floor(whole * x / run["cut"]).cast("int")
        start, shift = F.when(run["opens"], 0).otherwise(s["start"]), F.when(run["opens"], 0).otherwise(s["shift"])
        first, gain = edge(run["first"]) + shift, F.coalesce(run["gain"], part["more"] - shift)
        size = edge(run["end"]) - edge(run["first"]) + gain
        fits = (size >= 0) & (F.abs(gain) <= run["end"] - run["first"])
        rest = F.when(run["closes"], F.substring(line, at + first + size + 1, part["size"] - first - size)).otherwise("")
        new = F.struct((at + first).alias("at"), size.alias("size"), gain.alias("more"), F.xxhash64(F.substring(line, at + first + 1, size)).alias("mark"))
        state = {"key": F.xxhash64(s["key"], F.substring(line, at + start + 1, first - start), rest), "ok": s["ok"] & fits, "own": s["own"] & (gain == 0), "start": first + size, "shift": shift + gain, "parts": F.concat(s["parts"], F.array(new))}
        return F.struct(*(c.alias(name) for name, c in state.items()))

    def narrow(way: Column) -> Column:
        none = F.array().cast("array<struct<at:int,size:int,more:int,mark:bigint>>")
        first = {"key": F.xxhash64("key", way["number"]), "ok": way["both"] | ~own, "own": own, "start": F.lit(0), "shift": F.lit(0), "parts": none}
        to = lambda s: F.struct(s["key"].alias("key"), s["ok"].alias("ok"), s["own"].alias("own"), way["share"].alias("share"), s["parts"].alias("parts"))
        return F.aggregate(way["runs"], F.struct(*(c.alias(name) for name, c in first.items())), step, to)

    x = found.select("id", "n", "counts", "near", F.explode(F.filter(F.transform(ways, narrow), lambda x: x["ok"])).alias("x"))
    return x.select("x.key", (F.col("id") + F.col("x.own").cast("long")).alias("v"), "n", "counts", "x.share", "x.parts", "near")


def narrowest(edits: int) -> Column:
    """Whether no free part has more characters than edits in the line that is sought; the same for all lines of a key."""
    out = F.lit(None)
    for i, share in enumerate(shares(edits)):
        fits = (F.col("parts")[j]["size"] - F.col("parts")[j]["more"] <= k for j, k in enumerate(share))
        out = F.when(F.col("share") == i, functools.reduce(Column.__and__, fits)).otherwise(out)
    return out


def pairs_of_large(lines: DataFrame, texts: DataFrame, edits: int, least: int, used: list[DataFrame]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Pairs(a, b) among lines(id) that are left to compare, and ids and places of lines found near an earlier one; used gets the tables they read.

    Lines are grouped by all that is outside parts of them where the edits may be, and these parts are narrowed until
    a group has up to GROUP rows, or up to GROUP lines that are not near its earliest one: those are held against all of it.
    The rest are groups of lines equal but for as many characters as there are edits.
    """
    pairs, near = [], []
    rows = narrowed(whole_lines(texts.join(lines, "id", "left_semi"), edits, least), texts, edits)
    while True:
        shared = cut(shared_keys(rows), "line-keys")
        used.append(shared)
        pairs.append(pairs_of(shared.filter(F.col("size") <= GROUP), edits))
        large = shared.filter(F.col("size") > GROUP).drop("size")
        if large.isEmpty():
            return pairs, near
        placed = large.withColumn("id", _id(F.col("v"))).join(texts.select("id", "at", "line"), "id").repartition("key")
        earliest = placed.groupBy("key").agg(F.min(F.struct("at", "n", "counts", "line")).alias("e"))
        like = (F.abs(F.col("n") - F.col("e.n")) <= edits) & counts_near(F.col("counts"), F.col("e.counts"), edits)
        short = F.struct(*(chars(x).alias(c) for x, c in zip(trimmed(F.col("line"), F.col("e.line")), "xy", strict=True)))
        like = F.when((F.col("at") > F.col("e.at")) & like, F.transform(F.array(short), lambda z: within_edits(z["x"], z["y"], edits))[0])
        placed = placed.join(earliest.hint("shuffle_hash"), "key").withColumn("near", F.col("near") | F.coalesce(like, F.lit(False)))
        is_open = F.count_if(~F.col("near")).over(Window.partitionBy("key"))
        placed = cut(placed.select(*large.columns, "at", is_open.alias("open")), "line-large")
        used.append(placed)
        near.append(placed.filter("near").select(_id(F.col("v")).alias("id"), "at").distinct())
        wide = (F.col("open") > GROUP) & ~narrowest(edits)
        last = placed.filter(~wide)
        pairs.append(pairs_of(last.filter("NOT near"), edits, last))
        rows = narrowed(placed.filter(wide), texts, edits)


def shared_keys(rows: DataFrame) -> DataFrame:
    """The rows(key, v, any others) whose key is a line's own and has other lines too; and the size of the group.

    The rows are exchanged once: the join reads the exchange that the sums have read.
    """
    dealt = rows.repartition("key")
    v = F.col("v")
    groups = dealt.groupBy("key").agg(F.min(_id(v)).alias("least"), F.max(_id(v)).alias("most"), F.max(_own(v)).alias("own"), F.count("*").alias("size"))
    groups = groups.filter("own = 1 AND least <> most").select("key", "size")
    return dealt.join(groups.hint("shuffle_hash"), "key")


def pairs_of(rows: DataFrame, edits: int, others: DataFrame | None = None) -> DataFrame:
    """a, b (a < b) of each two lines of a group of which one's own segment is the key; with others, one of rows and one of others.

    Where rows have n and counts, pairs that these show to be far apart are left out; where they have free parts, pairs that
    are equal in one, as fewer parts hold all their edits.
    """
    more = [c for c in ("n", "counts", "parts") if c in rows.columns]
    side = lambda r, p: r.select("key", _id(F.col("v")).alias(p), _own(F.col("v")).alias(f"{p}_own"), *(F.col(c).alias(f"{p}_{c}") for c in more))
    found = F.col("x_own") == 1 if others is None else (F.col("x_own") == 1) | (F.col("y_own") == 1)
    near = (F.abs(F.col("x_n") - F.col("y_n")) <= edits) & counts_near(F.col("x_counts"), F.col("y_counts"), edits) if more else F.lit(True)
    if "parts" in more:
        near = near & F.forall(F.zip_with("x_parts", "y_parts", lambda a, b: a["mark"] != b["mark"]), lambda unlike: unlike)
    pairs = side(rows, "x").join(side(rows if others is None else others, "y"), "key").filter(found & (F.col("x") != F.col("y")) & near)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def chars(a: Column) -> Column:
    """The characters of a string."""
    return F.when(a != "", F.split(a, "")).otherwise(F.array().cast("array<string>"))


def _band(x: Column, y: Column, edits: int) -> Column:
    """Bits of the band after all characters of y, for up to edits edits.

    Bit o of word d says that the first j characters of y turn into the first j + o - edits of x by
    at most d edits; the 2 * edits + 1 bits are the band.  One step for each character of y updates all
    bits of a word together.  The state has numbers only, as each step copies it; x should be a column.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    first = F.struct(*(F.lit(((1 << (d + 1)) - 1) << edits & full).alias(f"r{d}") for d in range(edits + 1)), F.lit(-edits).alias("at"))

    def step(s: Column, c: Column) -> Column:
        # positions outside x give null, so no match; what is beyond x's end never comes back
        match = F.lit(0)
        for o in range(width):
            match = match.bitwiseOR(F.when(F.get(x, s["at"] + o) == c, 1 << o).otherwise(0))
        return F.transform(F.array(match), lambda m: words(s, m))[0]

    def words(s: Column, match: Column) -> Column:
        out = [s["r0"].bitwiseAND(match)]
        for d in range(1, edits + 1):
            old, new = s[f"r{d - 1}"], out[d - 1]
            out.append(s[f"r{d}"].bitwiseAND(match).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new, 1)).bitwiseAND(F.lit(full)))
        return F.struct(*(w.alias(f"r{d}") for d, w in enumerate(out)), (s["at"] + 1).alias("at"))

    return F.aggregate(y, first, step, lambda s: s[f"r{edits}"])


#: Characters after which a comparison is given up where no bit of the band is left.
PROBED = 24


def within_edits(x: Column, y: Column, edits: int) -> Column:
    """Whether the edit distance of two arrays of characters is at most edits: banded and bit-parallel.

    The band of the first PROBED characters is looked at first; without a bit left, no more edits can help.
    """
    m, n = F.size(x), F.size(y)
    near = F.abs(m - n) <= edits
    alive = _band(x, F.slice(y, 1, PROBED), edits) != 0
    whole = F.get(F.array(*(F.lit(1 << o) for o in range(2 * edits + 1))), m - n + edits)  # the bit of all of x
    return F.coalesce(F.when(near & alive, _band(x, y, edits).bitwiseAND(whole) != 0), F.lit(False))


def trimmed(a: Column, b: Column) -> tuple[Column, Column]:
    """Both strings without their common start; the edit distance stays the same."""
    least = F.least(F.char_length(a), F.char_length(b))
    steps = F.array(*(F.lit(1 << i) for i in range(20, -1, -1)))
    same = F.aggregate(steps, F.lit(0), lambda s, p: F.when((s + p <= least) & (F.substring(a, F.lit(1), s + p) == F.substring(b, F.lit(1), s + p)), s + p).otherwise(s))
    return F.substring(a, same + 1, F.lit(2**30)), F.substring(b, same + 1, F.lit(2**30))


def first_lines(docs: DataFrame) -> DataFrame:
    """d, mark, pos, id of each distinct non-blank line's first occurrence; docs has columns d and mark."""
    lines = docs.select("d", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    full = lines.select(line_id(F.col("line")).alias("id"), F.xxhash64("line", F.lit(1)).alias("h2"), place(F.col("d"), F.col("mark"), F.col("pos")).alias("at"))
    firsts = full.groupBy("id", "h2").agg(F.min("at").alias("at"))
    pos, mark, doc = _unplace(F.col("at"))
    return firsts.select(doc.alias("d"), mark.alias("mark"), pos.alias("pos"), "id")


def flags(positions: Column) -> Column:
    """A string with a 1 at each of the sorted positions and 0 before and between them."""
    before = lambda i: F.coalesce(F.get(positions, i - 1), F.lit(-1))
    return F.array_join(F.transform(positions, lambda p, i: F.concat(F.repeat(F.lit("0"), p - before(i) - 1), F.lit("1"))), "")


def flagged_lines(d: DataFrame) -> DataFrame:
    """d, mark, pos, line of the lines that the column flags marks: one pass over each text."""
    zipped = F.arrays_zip(F.split("text", "\n").alias("line"), F.split("flags", "").alias("flag"))
    return d.select("d", "mark", F.posexplode(zipped).alias("pos", "x")).filter("x.flag = '1'").select("d", "mark", "pos", F.col("x.line").alias("line"))


def with_flags(docs: DataFrame, lines: DataFrame, how: str, buckets: int) -> DataFrame:
    """docs with the flags of its rows in lines(d, mark, pos), in buckets by hash."""
    found = lines.repartition(buckets, "d", "mark").groupBy("d", "mark").agg(F.array_sort(F.collect_list("pos")).alias("pos")).select("d", "mark", flags(F.col("pos")).alias("flags"))
    return docs.join(found.hint("shuffle_hash"), ["d", "mark"], how)


def _compared(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """id and place of the later line of each of pairs(a, b) within edits edits."""
    near = pairs.distinct()
    for side in ("a", "b"):  # lengths and counts first: few pairs need their texts
        near = near.join(texts.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("counts").alias(f"{side}_counts")), side)
    near = near.filter((F.abs(F.col("a_n") - F.col("b_n")) <= edits) & counts_near(F.col("a_counts"), F.col("b_counts"), edits)).select("a", "b")
    for side in ("a", "b"):
        near = near.join(texts.select(F.col("id").alias(side), F.col("at").alias(f"{side}_at"), F.col("line").alias(f"{side}_line")), side)
    # a generated row keeps the trimmed lines from being made again for each use
    short_a, short_b = trimmed(F.col("a_line"), F.col("b_line"))
    near = near.select("a", "b", "a_at", "b_at", F.inline(F.array(F.struct(chars(short_a).alias("x"), chars(short_b).alias("y")))))
    near = near.select("a", "b", "a_at", "b_at", F.explode(F.array(within_edits(F.col("x"), F.col("y"), edits))).alias("near")).filter("near")
    return near.select(F.when(F.col("a_at") < F.col("b_at"), F.col("b")).otherwise(F.col("a")).alias("id"), F.greatest("a_at", "b_at").alias("at")).distinct()


def near_lines(marked: DataFrame, firsts: DataFrame, buckets: int, edits: int = MAX_EDITS, least: int = MIN_CHARS) -> DataFrame:
    """d, mark, pos of first occurrences within `edits` edits of a distinct line that occurs earlier.

    marked: documents with flags of their first occurrences; firsts: those with the ids of their lines.

    Lines that share a key are pairs in groups of up to GROUP.  Those of larger groups are grouped anew by
    all of the line but narrow parts (pairs_of_large).
    """
    lines = flagged_lines(marked).withColumn("n", F.char_length("line")).filter(F.col("n") >= least)
    shared = cut(shared_keys(segment_keys(lines, edits, least)), "line-keys")
    small, large = F.col("size") <= GROUP, shared.filter(F.col("size") > GROUP).drop("size")
    pairs = cut(pairs_of(shared.filter(small), edits).distinct(), "line-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select(_id(F.col("v")))).distinct()
    text = flagged_lines(with_flags(marked.select("d", "mark", "text"), firsts.join(ids, "id", "left_semi"), "inner", buckets))
    text = text.select(line_id(F.col("line")).alias("id"), place(F.col("d"), F.col("mark"), F.col("pos")).alias("at"), "line").distinct()
    text = cut(text.withColumn("n", F.char_length("line")).withColumn("counts", letter_counts(F.col("line"))), "line-texts")
    used, near = [shared, pairs, text], []
    if not large.isEmpty():
        more, near = pairs_of_large(large.select(_id(F.col("v")).alias("id")).distinct(), text, edits, least, used)
        pairs = functools.reduce(DataFrame.union, more, pairs)
    found = functools.reduce(DataFrame.union, near, _compared(pairs, text, edits))
    pos, mark, doc = _unplace(F.col("at"))
    out = cut(found.select("at").distinct().select(doc.alias("d"), mark.alias("mark"), pos.alias("pos")), "line-near")
    freed(*used)
    return out


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS) -> DataFrame:
    """docs(doc_id, text, any others) with line_text, n_lines, n_kept (non-blank lines) and n_near.

    A non-blank line is dropped where an equal line occurs earlier, by doc_id, then line number; its first occurrence
    is dropped where a distinct line of at least `least` characters within `edits` edits, if it
    has as many itself, occurs earlier, dropped or not.  Blank lines stay.  line_text has the lines left,
    joined by newlines: null for a null text, and empty where none is left.  Documents without an id come last.
    Rows of equal doc_id and text are one document and keep the same lines; rows of one doc_id and other texts
    are ordered by a hash of the text.  No row is left out; input columns named as added ones are replaced.

    Texts are exchanged once, with the flags of their first lines, into a table of hash buckets; keys, the texts of
    candidate pairs and the result are read from it without another exchange.  Lines of large groups are exchanged
    again with narrower keys, round by round, as long as their groups stay large.
    """
    marks = carried(docs, "doc_id", "text").withColumn("mark", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).cast("int"))
    marks = marks.withColumn("d", F.coalesce("doc_id", F.lit(LAST)).cast("long"))
    firsts = cut(first_lines(marks), "line-firsts")
    spark = docs.sparkSession
    buckets = min(parts_for(marks, "text", BUCKET_MB, spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    marked = cut_bucketed(with_flags(marks.repartition(buckets, "d", "mark"), firsts, "left", buckets), ["d", "mark"], buckets, "line-marked")
    near = near_lines(marked, firsts, buckets, edits, least)
    freed(firsts)
    dropped = with_flags(marked.withColumnRenamed("flags", "first_flags"), near, "left", buckets)
    zipped = F.arrays_zip(F.split("text", "\n").alias("line"), F.split(F.coalesce("first_flags", F.lit("")), "").alias("first"), F.split(F.coalesce("flags", F.lit("")), "").alias("near"))
    kept = F.filter("line_all", lambda x: (F.trim(x["line"]) == "") | ((x["first"] == "1") & ~F.coalesce(x["near"] == "1", F.lit(False))))
    filled = lambda c: F.coalesce(F.size(F.filter(c, lambda x: F.trim(x["line"]) != "")), F.lit(0)).cast("long")
    known = F.col("text").isNotNull()
    out = dropped.withColumn("line_all", F.filter(zipped, lambda x: x["line"].isNotNull())).withColumn("line_kept", kept)
    added = {
        "line_text": F.when(known, F.array_join(F.transform("line_kept", lambda x: x["line"]), "\n")),
        "n_lines": F.when(known, filled("line_all")).otherwise(0),
        "n_kept": F.when(known, filled("line_kept")).otherwise(0),
        "n_near": F.length(F.replace(F.coalesce("flags", F.lit("")), F.lit("0"), F.lit(""))).cast("long"),
    }
    return uncarried(out, docs.columns, ("doc_id", "text"), added)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_kept", "n_near", F.col("line_text").alias("text"))


#: Characters by whose counts the SQL passes over pairs.
SQL_COUNTED = "enta"
OP1_SQL = f"""
WITH o AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, lines[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), generate_series(1, len(lines)) AS g(i)
), f AS (
  SELECT line, min(row(doc_id, pos)) AS first FROM o WHERE trim(line) <> '' GROUP BY line
), u AS (SELECT line, first, length(line) AS n,
  {", ".join(f"length(replace(line, '{c}', '')) AS c{i}" for i, c in enumerate(SQL_COUNTED))}
  FROM f WHERE length(line) >= {MIN_CHARS}),
near AS (
  SELECT DISTINCT b.line FROM u a JOIN u b ON a.n BETWEEN b.n - {MAX_EDITS} AND b.n + {MAX_EDITS} AND a.first < b.first
    AND {" AND ".join(f"abs(a.c{i} - b.c{i}) <= {2 * MAX_EDITS}" for i in range(len(SQL_COUNTED)))}
  WHERE levenshtein(a.line, b.line) <= {MAX_EDITS}
), k AS (
  SELECT o.doc_id, o.pos, o.line, trim(o.line) = '' AS blank, n.line IS NOT NULL AND f.first = row(o.doc_id, o.pos) AS near,
    trim(o.line) = '' OR (f.first = row(o.doc_id, o.pos) AND n.line IS NULL) AS keep
  FROM o LEFT JOIN f ON f.line = o.line LEFT JOIN near n ON n.line = o.line
)
SELECT d.doc_id, CAST(coalesce(count(k.pos) FILTER (NOT blank), 0) AS BIGINT) AS n_lines, CAST(coalesce(count(k.pos) FILTER (keep AND NOT blank), 0) AS BIGINT) AS n_kept,
  CAST(coalesce(count(k.pos) FILTER (near), 0) AS BIGINT) AS n_near,
  CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (keep), '') END AS text
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""
