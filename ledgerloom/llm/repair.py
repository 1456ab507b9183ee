"""Conversation structure repair: cheapest edits, solved once per shared suffix of role and fault signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

# White space of a turn's text, and the signs that may end it.
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"
# A turn as one sign: which role its name begins with, times what is wrong with it.
ROLES, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
SIGNS = "ABCDEFGHIJKLMNOP"
# Grammar states: nothing yet, after the system turn, after a user, after an assistant; the first and last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5


def settled(turn: dict[int, tuple[int, str, int]]) -> tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]:
    """Costs, edits and next states per state, where a state may first insert the turn that the grammar wants.

    ``turn`` gives per state the cost, edit and next state without an insertion. Each edit leads to one
    choice only, so of equally cheap audits the least is the one whose first letter is least.
    """
    best = dict(turn)
    for _ in range(4):
        for state in range(4):
            role = "a" if state == USER else "u"
            after = AFTER[role][state]
            if after in best:
                offer = (best[after][0] + INSERT, "I", after)
                if state not in best or offer[:2] < best[state][:2]:
                    best[state] = offer
    return tuple(tuple(best[s][i] for s in range(4)) for i in range(3))


class Suffixes:
    """The automaton of signatures, minimised from their ends, for signatures that come sorted by their mirror image.

    A node is a distinct suffix. Mirrored order keeps equal suffixes next to one another, so the nodes of
    the suffix at hand form a stack, each is made and solved once, and memory follows the longest signature.
    Costs to go from a node, less the least of them, take few forms; a form and a sign give the form before.
    """

    def __init__(self):
        end = settled({START: (0, "", -1), ASSISTANT: (0, "", -1)})
        self.forms: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int, tuple[str, ...], tuple[int, ...]]] = {}
        self.end_edits, self.end_next = end[1:]
        self.made = 0
        least, form = self.form_of(end[0])
        # Per node of the stack: its form and its least cost to go.
        self.stack, self.mirror = [(form, least)], ""

    def form_of(self, costs: tuple[int, ...]) -> tuple[int, int]:
        least = min(costs)
        form = tuple(c - least for c in costs)
        if form not in self.number:
            self.number[form] = len(self.forms)
            self.forms.append(form)
        return least, self.number[form]

    def step(self, form: int, sign: str) -> tuple[int, int, tuple[str, ...], tuple[int, ...]]:
        """The form before ``sign``, how much the least cost grows, and per state the edit and the next state."""
        found = self.steps.get((form, sign))
        if found is None:
            role, fault = divmod(SIGNS.index(sign), 4)
            later, options = self.forms[form], {}
            for state in range(4):
                choices = [(DELETE + later[state], "D", state)]
                if FAULTS[fault] in ("none", "truncated"):
                    more = CUT if FAULTS[fault] == "truncated" else 0
                    kept = AFTER[ROLES[role]].get(state) if role < 3 else None
                    if kept is not None:
                        choices.append((more + later[kept], "K", kept))
                    turned = ASSISTANT if state == USER else USER
                    choices.append((more + REROLE + later[turned], "R", turned))
                options[state] = min(choices)
            costs, edits, after = settled(options)
            least, before = self.form_of(costs)
            found = self.steps[form, sign] = (before, least, edits, after)
        return found

    def solve(self, mirror: str) -> tuple[int, str]:
        """Least cost and least audit of a signature, given from its end to its start."""
        shared, limit = 0, min(len(mirror), len(self.mirror))
        if mirror[:limit] == self.mirror[:limit]:
            shared = limit
        else:
            while mirror[shared] == self.mirror[shared]:
                shared += 1
        del self.stack[shared + 1 :]
        self.mirror = mirror
        form, least = self.stack[-1]
        for sign in mirror[shared:]:
            form, more, _, _ = self.step(form, sign)
            least += more
            self.stack.append((form, least))
            self.made += 1
        audit, state = [], START
        cost = least + self.forms[form][state]
        for at in range(len(mirror) - 1, -1, -1):
            _, _, edits, after = self.step(self.stack[at][0], mirror[at])
            while edits[state] == "I":
                audit.append("I")
                state = after[state]
            audit.append(edits[state])
            state = after[state]
        while self.end_edits[state] == "I":
            audit.append("I")
            state = self.end_next[state]
        return cost, "".join(audit)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of signatures of sorted turns, one per conversation and task."""
    names = ["key", "at_turn", "at_role", "at_digest", "piece", "low", "high", "turns"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    now: list | None = None
    signs: list[str] = []

    def row() -> list:
        return [*now[:4], "".join(signs), *now[4:]]

    for batch in batches:
        done = []
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for key, turn, role, digest, piece in zip(*columns, strict=True):
            if now is None or now[0] != key:
                if now is not None:
                    done.append(row())
                now, signs = [key, turn, role, digest, None, None, 0], []
            signs.append(piece)
            if piece and turn is not None:
                if now[4] is None:
                    now[4] = turn
                now[6] += turn != now[5]
                now[5] = turn
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row(), kinds, strict=True)], names=names)


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Suffixes()
    for batch in batches:
        mirrors = batch.column(0).to_pylist()
        answers = [automaton.solve(m) for m in mirrors]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([c for c, _ in answers], pa.int64()), pa.array([a for _, a in answers], pa.string())],
            names=["mirror", "cost", "audit"],
        )


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired conversation, from its audit and its turns in order."""
    state = START
    for edit in audit:
        role, text = ("assistant" if state == USER else "user", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "R":
            role = "assistant" if state == USER else "user"
        state = AFTER[role[:1]][state]
        yield edit, role, text


class Turns:
    """One conversation's part of a sorted stream of headers and turns; the header comes first."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        self.next = next(self.rows, None)

    def conversations(self) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
        while self.next is not None:
            header, self.next = self.next, next(self.rows, None)
            of_one = self.of(header[0])
            yield header, of_one
            for _ in of_one:
                pass

    def of(self, key: str) -> Iterator[tuple[str, str]]:
        while self.next is not None and self.next[0] == key:
            row, self.next = self.next, next(self.rows, None)
            for _ in range(row[3]):
                yield row[1], row[2]


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[str, str]] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in zip(*found, strict=True)], names=["key", "repaired_sha256"])

    for header, turns in Turns(batches).conversations():
        digest, first = hashlib.sha256(), True
        for _, role, text in edited(header[2], turns):
            digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
            first = False
        found.append((header[0], digest.hexdigest()))
        if len(found) == 4096:
            yield out()
            found = []
    if found:
        yield out()


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("key", pa.string()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    found, held = [], 0

    def out() -> pa.RecordBatch:
        columns = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    for header, turns in Turns(batches).conversations():
        for position, (edit, role, text) in enumerate(edited(header[2], turns)):
            found.append((header[0], position, edit, role, text))
            held += len(text)
            if len(found) == 4096 or held > 4 << 20:
                yield out()
                found, held = [], 0
    if found:
        yield out()


class Repair:
    """Repair of the conversations in ``turns`` (columns of the given names, ``copies`` of each row).

    A conversation's rows stand in order of turn (missing ones first), then role, then the text's SHA-256;
    missing roles and texts count as one space, and a missing conversation id is an id of its own. A row
    with no copies only makes its conversation known. The first of these faults counts: ``blank``,
    ``duplicate`` (role and text seen earlier), ``truncated`` (does not end in ``.``, ``!`` or ``?``).

    Edits keep a turn, give it the role that the grammar wants (1), delete it (2, a must for blank and
    duplicate ones) or insert an empty one (5); truncated turns that stay cost 5 more. The result reads
    system (or not), then user and assistant in turn, or is empty.

    Signatures carry one sign a turn. They are cut from a range-sorted table without texts, so a long
    conversation is spread over many tasks; distinct ones are dealt by their mirror images and solved
    on shared suffixes. Texts move once, to be read in order beside their audit. What one task must do
    for one conversation is walk its signs and hash its text, both in a stream.
    """

    def __init__(
        self,
        turns: DataFrame,
        conv_col: str = "conv_id",
        turn_col: str = "turn",
        role_col: str = "role",
        text_col: str = "text",
        copies: Column | None = None,
    ):
        conv, space = F.col(conv_col), F.lit(" ")
        self.id_kind = turns.schema[conv_col].dataType
        rows = turns.select(
            F.when(conv.isNull(), "-").otherwise(F.concat(F.lit("+"), conv.cast("string"))).alias("key"),
            F.col(turn_col).cast("bigint").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
            (F.lit(1) if copies is None else copies).cast("bigint").alias("copies"),
        )
        self.rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
        self.headers = written(self._headers(), "audits")

    def _signatures(self) -> DataFrame:
        bare = F.rtrim("text", F.lit(SPACES))
        seen = F.when(bare == "", 1).when(~F.substring(bare, -1, 1).isin(*ENDS), 3).otherwise(0)
        alike = (
            self.rows.select("key", "turn", "role", "digest", "copies", seen.alias("fault"))
            .groupBy("key", "role", "digest", "turn")
            .agg(F.sum("copies").alias("copies"), F.first("fault").alias("fault"))
        )
        # Least turn per role and text; missing turns come first, and rows without copies do not count.
        there = F.when(F.col("copies") > 0, F.struct(F.col("turn").isNotNull().alias("given"), "turn"))
        first = alike.groupBy("key", "role", "digest").agg(F.min(there).alias("first"))
        initial = F.substring("role", 1, 1)
        sign = F.coalesce(*(F.when(initial == r, i) for i, r in enumerate(ROLES)), F.lit(len(ROLES)))
        letter = lambda fault: F.substring(F.lit(SIGNS), sign * 4 + fault + 1, F.lit(1))
        is_first = there == F.col("first")
        one = F.when(F.col("fault") == 1, 1).when(~is_first, 2).otherwise(F.col("fault"))
        more = F.when(F.col("fault") == 1, 1).otherwise(2)
        piece = F.when(F.col("copies") > 0, F.concat(letter(one), F.repeat(letter(more), (F.col("copies") - 1).cast("int"))))
        marked = alike.join(first, ["key", "role", "digest"]).select(
            "key", "turn", "role", "digest", F.coalesce(piece, F.lit("")).alias("piece")
        )
        order = ["key", "turn", "role", "digest"]
        cut = marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            pieces,
            "key string, at_turn bigint, at_role string, at_digest binary, piece string, "
            "low bigint, high bigint, turns bigint",
        )
        part = F.struct("at_turn", "at_role", "at_digest", "piece", "low", "high", "turns")
        whole = cut.groupBy("key").agg(F.array_sort(F.collect_list(part)).alias("parts"))
        # Two stretches that meet within a turn have counted it twice.
        twice = F.expr(
            "aggregate(parts, named_struct('n', 0L, 'last', cast(null as bigint)), (a, p) -> named_struct("
            "'n', a.n + p.turns - if(p.low = a.last, 1L, 0L), 'last', coalesce(p.high, a.last)), a -> a.n)"
        )
        return whole.select(
            "key",
            F.array_join("parts.piece", "").alias("signature"),
            F.coalesce(F.array_max("parts.high") - F.array_min("parts.low") + 1 - twice, F.lit(0)).cast("bigint").alias("gaps"),
        )

    def _headers(self) -> DataFrame:
        signed = written(self._signatures(), "signatures").withColumn("mirror", F.reverse("signature"))
        distinct = signed.select("mirror").distinct()
        answers = distinct.repartitionByRange("mirror").sortWithinPartitions("mirror").mapInArrow(
            solved, "mirror string, cost bigint, audit string"
        )
        return signed.join(answers, "mirror").drop("mirror")

    def summary(self) -> DataFrame:
        """Per conversation: ``gaps`` in its turns, counts of faults and of ``illegal`` neighbours, ``cost``, ``audit``, ``repaired_sha256``."""
        signs = F.col("signature")
        count = lambda letters: (F.length(signs) - F.length(F.translate(signs, letters, ""))).cast("bigint")
        # Legal neighbours are counted as the places where the roles, one letter a turn, read su, ua or au.
        roles = F.translate(signs, SIGNS, "".join(r * 4 for r in "suax"))
        legal = F.regexp_count(roles, F.lit("s(?=u)|u(?=a)|a(?=u)"))
        of = self._in_order().mapInArrow(digests, "key string, repaired_sha256 string")
        return self.headers.join(of, "key").select(
            self._id(),
            "gaps",
            *(count("".join(SIGNS[4 * r + i] for r in range(4))).alias(f) for i, f in enumerate(FAULTS) if i),
            (F.greatest(F.length(signs) - 1, F.lit(0)) - legal).cast("bigint").alias("illegal"),
            "cost",
            "audit",
            "repaired_sha256",
        )

    def turns(self) -> DataFrame:
        """The repaired turns: ``conv_id``, ``position`` (from 0), ``edit`` (K, R or I), ``role``, ``text``."""
        of = self._in_order().mapInArrow(repaired, "key string, position bigint, edit string, role string, text string")
        return of.select(self._id(), "position", "edit", "role", "text")

    def _id(self) -> Column:
        return F.when(F.col("key") != "-", F.substr("key", F.lit(2)).cast(self.id_kind)).alias("conv_id")

    def _in_order(self) -> DataFrame:
        none = F.lit(None)
        headers = self.headers.select(
            "key", F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("copies"),
            F.lit(0).alias("kind"), none.cast("bigint").alias("turn"), none.cast("binary").alias("digest"),
        )
        turns = self.rows.where("copies > 0").select("key", "role", "text", "copies", F.lit(1).alias("kind"), "turn", "digest")
        order = ["key", "kind", "turn", "role", "digest"]
        return headers.union(turns).repartition("key").sortWithinPartitions(*order).select("key", "role", "text", "copies")
