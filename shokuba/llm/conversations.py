"""Cheapest repair of conversations: faults per row, then one dynamic programme over grammar-compressed fault sequences."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shokuba.llm.common import SPACE, join_by_heavy, stage

_BLANKS = " \t\n\x0b\f\r"
_PIECE = 256  # symbols of a piece of a conversation
_RULE = 0x100  # code point of the first rule's symbol; rows are letters below it

#: What a row allows: s, u, a its role's initial, o any other; capital letters for truncated rows; D must be deleted.
_LETTERS = "suaoSUAOD"
#: States: nothing yet, after system, after user, after assistant. The first and the last are ends.
_AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Inserts before a row (or at the end): from, to, how many.
_INSERTS = [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (0, 3, 2), (1, 3, 2)]
_ENDS = {0: 0, 3: 0, 2: 1, 1: 2}  # inserts that end each state


class Rope:
    """A string kept as its two parts, which other ropes share; put together only when it is asked for."""

    __slots__ = ("left", "right", "text")

    def __init__(self, left: Rope | None, right: Rope | None, text: str | None = None):
        self.left, self.right, self.text = left, right, text

    def __str__(self) -> str:
        if self.text is None:
            self.text = str(self.left) + str(self.right)
        return self.text


Matrix = dict[tuple[int, int], tuple[int, Rope]]


def row_matrix(letter: str) -> Matrix:
    """Cheapest edits from state to state over one row with the inserts before it: cost and audit.

    As inserts belong to the row behind them, the audits of one cell all end with a row's edit. None is then the start
    of another, so the least of them stays the least whatever follows.
    """
    moves = [(i, i, 2, "D") for i in range(4)]
    if letter != "D":
        late = 5 * letter.isupper()
        moves += [(i, j, late, "K") for i, j in _AFTER.get(letter.lower(), {}).items()]
        moves += [(i, j, 1 + late, "R") for role in "ua" for i, j in _AFTER[role].items()]
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for i, k, n in _INSERTS:
        for start, j, cost, edit in moves:
            if start == k:
                new = (5 * n + cost, "I" * n + edit)
                out[i, j] = min(out.get((i, j), new), new)
    return {ij: (cost, Rope(None, None, text)) for ij, (cost, text) in out.items()}


def product(a: Matrix, b: Matrix) -> Matrix:
    """Cheapest edits over both; equal costs are decided by the audits."""
    out: Matrix = {}
    for (i, k), (x, left) in a.items():
        for j in range(4):
            if (step := b.get((k, j))) is None:
                continue
            cost, old = x + step[0], out.get((i, j))
            if old is None or cost < old[0]:
                out[i, j] = (cost, Rope(left, step[1]))
            elif cost == old[0] and str(new := Rope(left, step[1])) < str(old[1]):
                out[i, j] = (cost, new)
    return out


def rule_matrices(rules: list[str]) -> dict[str, Matrix]:
    """The matrix of each letter and, from below upwards, of each rule (a pair of symbols that are known before it)."""
    known = {x: row_matrix(x) for x in _LETTERS}
    for i, (left, right) in enumerate(rules):
        known[chr(_RULE + i)] = product(known[left], known[right])
    return known


def compress(symbols: str, rules: list[str]) -> str:
    """Each rule's pair replaced from left to right, in the order of the rules."""
    for i, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(_RULE + i))
    return symbols


def re_pair(shapes: DataFrame, rounds: int = 8, width: int = 32) -> list[str]:
    """Rules of a grammar over all sequences of `shapes` (symbols): at most `rounds` x `width` pairs of symbols.

    Each round counts neighbours over all sequences, as the rules so far leave them, and takes the most frequent pairs
    that can't overlap each other, ties by code points. Fewer rules make longer products, never other results.
    """
    rules: list[str] = []
    for _ in range(rounds):
        known = list(rules)

        def count(batches, known=known):
            found: Counter = Counter()
            for b in batches:
                for s in b.column(0).to_pylist():
                    s, last = compress(s, known), ""
                    for pair in map("".join, zip(s, s[1:])):
                        last = "" if pair == last and pair[0] == pair[1] else pair  # aaa holds aa once
                        found[last] += bool(last)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

        best = shapes.select("symbols").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        firsts, seconds, taken = set(), set(), []
        for r in best.filter("pair <> '' and n > 1").orderBy(F.desc("n"), "pair").limit(width).collect():
            a, b = r["pair"]
            if a in seconds or b in firsts or (a == b and a in firsts):
                continue
            taken.append(r["pair"])
            firsts.add(a)
            seconds.add(b)
        if not taken:
            break
        rules += taken
    return rules


def solve(shapes: DataFrame, rules: list[str]) -> DataFrame:
    """symbols, n, costs and audits (16 cells, state by state, null where there is no way) of each different sequence."""
    known = rule_matrices(rules)

    def run(batches):
        still = {(i, i): (0, Rope(None, None, "")) for i in range(4)}
        for b in batches:
            costs, audits = [], []
            for s in b.column(0).to_pylist():
                now = still
                for k, x in enumerate(compress(s, rules)):
                    now = product(now, known[x]) if k else known[x]
                cells = [now.get((i, j)) for i in range(4) for j in range(4)]
                costs.append([c and c[0] for c in cells])
                audits.append([c and str(c[1]) for c in cells])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], names=["symbols", "n", "costs", "audits"])

    return shapes.select("symbols", "n").mapInArrow(run, "symbols string, n long, costs array<long>, audits array<string>")


def damage(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, n: each row of a conversation as damaged, `n` times.

    conv is conv_id as text, so that null is a key too. crc32 of `conv_id:turn` modulo 20 says the damage: 0 drops the
    row (n is 0, and it holds the conversation's place), 1 empties the text, 2 takes out `.!?`, 3 doubles it, 4 sets the
    role user. Null counts as one space in key, role and text.
    """
    space = F.lit(" ")

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), space)

    key = F.concat(text("conv_id"), F.lit(":"), text("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    return rows.select(
        F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("conv"),
        F.when(kind > 0, F.col("turn").cast("long")).alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind < 2, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def mark_faults(lines: DataFrame) -> DataFrame:
    """conv, turn, role, th, n, symbol, fault of each line: rows of a conversation equal in all columns, `n` of them.

    Rows lie by turn (nulls first), then role, then the text's SHA-256. Of rows with the same role and text the first
    is none, all others are duplicates: those of the line itself, and whole lines at a later turn. fault is what the
    line's first row has, symbol what that row allows.
    """
    key = ["conv", "role", "th"]
    several = lines.filter("n > 0").groupBy(*key).agg(F.count("*").alias("w"), F.min(F.coalesce(F.col("turn"), F.lit(-(2**63)))).alias("first"))
    marked = join_by_heavy(lines, stage(several.filter("w > 1"), "several"), key, "w", "left")
    later = F.coalesce(F.col("first") < F.coalesce(F.col("turn"), F.lit(-(2**63))), F.lit(False))
    fault = F.when(F.col("blank"), "b").when(later, "d").when(F.col("cut"), "t").otherwise("")
    initial = F.when(F.col("role").rlike(r"\A[sua]"), F.substring("role", 1, 1)).otherwise("o")
    marked = marked.withColumn("fault", fault)
    symbol = F.when(F.col("fault").isin("b", "d"), "D").when(F.col("fault") == "t", F.upper(initial)).otherwise(initial)
    return marked.select("conv", "turn", "role", "th", "n", symbol.alias("symbol"), "fault")


_STATS = "blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long"
_PIECES = f"conv string, turn long, role string, th string, i int, symbols string, {_STATS}"


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            yield from b.slice(i, 1000).to_pylist()


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in ddl.split(", "))])


def cut_pieces(marked: DataFrame, most: int = _PIECE) -> DataFrame:
    """Stretches of at most `most` rows of one conversation, with what must be known to add them up.

    Lines are dealt out by ranges of conversation, turn, role and text, so a conversation of any length lies in several
    partitions, each of which cuts its own part. A piece is placed by its first line and its number there.
    """
    order = ["conv", "turn", "role", "th"]

    def run(batches):
        schema, out, piece = _schema(_PIECES), [], None
        for r in _rows(batches):
            copies, i = r["n"], 0
            while True:
                if piece is None or piece["conv"] != r["conv"] or len(piece["symbols"]) >= most:
                    if piece:
                        out.append(piece)
                        if len(out) >= 1000:
                            yield _batch(out, schema)
                            out = []
                    piece = {x: r[x] for x in order} | {"i": i, "symbols": "", "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": None, "tail": None, "low": None, "high": None, "turns": 0}
                if not copies:
                    break
                take = min(copies, most - len(piece["symbols"]))
                first, initial = not i, r["role"][:1]
                piece["symbols"] += (r["symbol"] if first else "D") + "D" * (take - 1)
                piece["blank"] += take if r["fault"] == "b" else 0
                piece["truncated"] += first and r["fault"] == "t"
                piece["duplicate"] += 0 if r["fault"] == "b" else take if r["fault"] == "d" else take - first
                piece["illegal"] += take - 1 + (piece["tail"] is not None and piece["tail"] + initial not in ("su", "ua", "au"))
                piece["head"] = initial if piece["head"] is None else piece["head"]
                piece["tail"] = initial
                if r["turn"] is not None:
                    piece["turns"] += r["turn"] != piece["high"]
                    piece["low"] = r["turn"] if piece["low"] is None else piece["low"]
                    piece["high"] = r["turn"]
                copies -= take
                i += take
        if piece:
            out.append(piece)
        if out:
            yield _batch(out, schema)

    return marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _PIECES)


class _Fold:
    """Adds up the pieces of one conversation in their order; strings are put together once, at the end."""

    def __init__(self):
        self.totals = Counter(blank=0, duplicate=0, truncated=0, illegal=0, turns=0)
        self.low = self.high = self.tail = None
        self.cost, self.place, self.steps = {0: 0}, {0: 0}, []  # place: order of the states' audits so far

    def add(self, r: dict) -> None:
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            self.totals[k] += r[k]
        if r["head"] is not None:
            self.totals["illegal"] += self.tail is not None and self.tail + r["head"] not in ("su", "ua", "au")
            self.tail = r["tail"]
        if r["low"] is not None:
            self.totals["turns"] -= r["low"] == self.high
            self.low = r["low"] if self.low is None else self.low
            self.high = r["high"]
        if not r["symbols"]:
            return
        best: dict[int, tuple] = {}
        for k, cost in self.cost.items():
            for j in range(4):
                if (c := r["costs"][4 * k + j]) is not None:
                    new = (cost + c, self.place[k], r["audits"][4 * k + j], k)
                    best[j] = min(best.get(j, new), new)
        order = sorted({b[1:3] for b in best.values()})
        self.cost = {j: b[0] for j, b in best.items()}
        self.place = {j: order.index(b[1:3]) for j, b in best.items()}
        self.steps.append({j: (b[3], b[2]) for j, b in best.items()})

    def _back(self, state: int) -> str:
        parts = []
        for step in reversed(self.steps):
            state, text = step[state]
            parts.append(text)
        return "".join(reversed(parts))

    def result(self) -> dict:
        least = min(c + 5 * _ENDS[j] for j, c in self.cost.items())
        audit = min(self._back(j) + "I" * _ENDS[j] for j, c in self.cost.items() if c + 5 * _ENDS[j] == least)
        out = {k: self.totals[k] for k in ("blank", "duplicate", "truncated", "illegal")}
        return out | {"gaps": 0 if self.low is None else self.high - self.low + 1 - self.totals["turns"], "cost": least, "audit": audit}


class _Hash:
    """SHA-256 of a repaired conversation, fed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.empty = audit, 0, 0, hashlib.sha256(), True

    def _say(self, role: str, text: str) -> None:
        self.sha.update(("" if self.empty else "\n").encode() + role.encode() + b":" + text.encode())
        self.empty = False

    def _next(self) -> str:
        """The role that fits now."""
        self.state = 3 if self.state == 2 else 2
        return "assistant" if self.state == 3 else "user"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._say(self._next(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            self._say(self._next(), text)
        elif edit == "K":
            self.state = _AFTER[role[0]][self.state]
            self._say(role, text)


_REPAIRED = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repair(batches) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation come with its pieces first, then its lines, all in order."""
    schema, out, conv, fold, sha = _schema(_REPAIRED), [], None, None, None

    def close() -> dict:
        found, h = (fold.result(), sha) if sha is None else (sha.found, sha)
        if h is None:
            h = _Hash(found["audit"])
        h.inserts()
        return {"conv": conv, **found, "repaired_sha256": h.sha.hexdigest()}

    for r in _rows(batches):
        if r["conv"] != conv:
            if conv is not None:
                out.append(close())
                if len(out) >= 500:
                    yield _batch(out, schema)
                    out = []
            conv, fold, sha = r["conv"], _Fold(), None
        if r["kind"] == 0:
            fold.add(r)
            continue
        if sha is None:
            found = fold.result()
            sha = _Hash(found["audit"])
            sha.found, fold = found, None
        for _ in range(r["n"]):
            sha.row(r["role"], r["text"])
    if conv is not None:
        out.append(close())
    if out:
        yield _batch(out, schema)


def repair_conversations(rows: DataFrame, damaged: bool = False, rounds: int = 8, width: int = 32, piece: int = _PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    `rows` are conv_id, turn, role, text; they are damaged first (`damage`), or taken as `damage` returns them. Rows
    lie by turn, nulls first; rows of one turn by role and then by the SHA-256 of their text. Null conv_ids are one
    conversation. A conversation without rows has zeros, an empty audit and the hash of an empty text; an empty table
    gives an empty result; other columns are not read.

    Each row is a symbol of role and fault. Conversations are cut into pieces, equal pieces are solved once, and a
    Re-Pair grammar over all different pieces lets frequent stretches share one min-plus matrix with its audits. Equal
    rows are added up before they move, faults meet by hashes of role and text with frequent ones broadcast, and a
    conversation of any length is marked and solved in parts. Only its pieces and the SHA-256 over its repaired text,
    which has an order, go through one task, row by row; the audit, one cell of the result, is held there.
    """
    lines = (rows if damaged else damage(rows)).groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    text = F.rtrim(F.col("text"), F.lit(_BLANKS))
    lines = lines.withColumns({"th": F.sha2("text", 256), "blank": ~F.col("text").rlike(SPACE.replace("[", "[^")), "cut": ~F.substring(text, -1, 1).isin(".", "!", "?")})
    lines = stage(lines, "lines")
    marked = stage(mark_faults(lines.drop("text")), "marked")
    pieces = stage(cut_pieces(marked, piece), "pieces")
    shapes = stage(pieces.groupBy("symbols").agg(F.count("*").alias("n")), "shapes")
    solved = stage(solve(shapes, re_pair(shapes, rounds, width)), "solved")
    heads = join_by_heavy(pieces, solved, ["symbols"], "n").withColumn("kind", F.lit(0)).drop("n")
    whole = lines.filter("n > 0").select("conv", "turn", "role", "th", "text", "n").withColumn("kind", F.lit(1)).withColumn("i", F.lit(0))
    both = heads.unionByName(whole, allowMissingColumns=True)
    done = both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "th", "i").mapInArrow(_repair, _REPAIRED)
    conv_id = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(rows.schema["conv_id"].dataType if not damaged else "string")
    return done.select(conv_id.alias("conv_id"), *[f.split()[0] for f in _REPAIRED.split(", ")[1:]])
