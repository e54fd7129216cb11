"""Per-entity streaming state: sliding windows and priors, read before commit.

Every event becomes one row per entity it names, so a single stateful stage
serves customers, cards, merchants and devices. No state value grows with its
entity:

* `head`, one value: running priors and the newest events, at most `rows` of them.
  An entity with few events has nothing else.
* `minutes`, a map by cell of time, a minute or more (`cell`): number, sum and parts of the
  events that left the head, and how many merchants were seen last in that cell.
* `chunks`, a map by cell and part: those events, at most `rows` each.
* `seen`, a map by merchant, for entities with distinct windows: when it was last
  among the events that left the head.

A window is the sum of the whole cells inside it and of the events of the two
cells at its edges, so it is exact, and a batch reads what lies at its edges and
not the window. A cell goes when the next event shows that no window reaches it;
with `lateness` an event-time timer also empties entities that fall silent. A cell that
holds a handful of events costs as many calls as a full one, so wide cells suit batches that
span hours, and minutes suit short ones.

With `parts` the entities of a kind are dealt over that many groups, and the same
values lie in maps that begin with the entity's id. A call then serves all entities
of a group, so its fixed cost (a few milliseconds) is paid per group and not per entity.
The heads of a group lie in pages, several to a state value; pages double in number
before one holds more than `PAGE_ROWS` rows. With an expiry each head has a value of its
own, since an idle entity must go while others of its group stay.
Rows of one group are packed where they arise, many to a row, because Spark hands the
rows of this stage to Python one at a time; with `lateness` they are not, since the
watermark looks at single rows.

Order: rows of one micro-batch in (event time, seq); earlier micro-batches come
first. A late event reads only what is not newer than itself, and without
`lateness` it is never dropped.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch import config as C
from tidewatch.functions import expr as X

MICRO = 1_000_000
MINUTE = 60 * MICRO
#: Events that one state value may hold.
ROWS = 256
_EVENTS = "at array<long>, amt array<long>, merch array<string>"
#: Groups of a kind of entity in the queries, and minutes of a cell in them.
PARTS = 1024
CELL_MINUTES = 60
#: Rows that are held to be packed; a pack has those of one group among them.
PACK_ROWS = 1 << 19
#: Rows (entities and their events) of a page of heads.
PAGE_ROWS = 8192
_PACKED = pa.schema([("eid", pa.string()), ("transaction_id", pa.string()), ("seq", pa.int64()),
                     ("at", pa.int64()), ("amt", pa.int64()), ("merch", pa.string())])
HEAD_SCHEMA = f"n long, a long, prev_at long, prev_amt long, spilled boolean, due long, {_EVENTS}"
MINUTE_SCHEMA = "n long, a long, last_seen long, parts int"


def entity_rows(txn: DataFrame, entities: tuple[C.Entity, ...] = C.CATALOGUE) -> DataFrame:
    """One row per event and entity it names; events without an id leave none."""
    kinds = F.array(*[F.struct(F.lit(e.name).alias("ent"), F.col(e.id_col).alias("eid")) for e in entities])
    rows = txn.select(
        "transaction_id", "seq", "event_time", X.micros("event_time").alias("at"),
        X.money_units(F.coalesce(F.col("amount").cast("double"), F.lit(0.0))).alias("amt"),
        F.coalesce("merchant_id", F.lit("")).alias("merch"), F.explode(kinds).alias("k"))
    return (rows.select("k.*", "transaction_id", "seq", "event_time", "at", "amt", "merch")
            .filter(F.coalesce("eid", F.lit("")) != ""))


_PAGE = pa.schema([("eid", pa.string()), ("n", pa.int64()), ("a", pa.int64()), ("prev_at", pa.int64()), ("prev_amt", pa.int64()),
                   ("spilled", pa.bool_()), ("due", pa.int64()), ("at", pa.list_(pa.int64())), ("amt", pa.list_(pa.int64())),
                   ("merch", pa.list_(pa.string()))])


def _packs(rows: pa.Table) -> pa.RecordBatch:
    ent = rows["ent"].combine_chunks().dictionary_encode()
    kind, part = ent.indices.to_numpy(zero_copy_only=False), rows["part"].to_numpy()
    order = np.lexsort((part, kind))
    kind, part = kind[order], part[order]
    first = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (part[1:] != part[:-1])])
    laid = rows.select(_PACKED.names).cast(_PACKED).combine_chunks().take(order).combine_chunks().to_batches()[0]
    packs = [laid.slice(lo, hi - lo).serialize().to_pybytes() for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True)]
    return pa.RecordBatch.from_arrays([ent.dictionary.take(pa.array(kind[first])), pa.array(part[first]), pa.array(packs, pa.binary())],
                                      names=["ent", "part", "pack"])


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entity rows of a task as (ent, part, pack): one row for those of a group among `PACK_ROWS` rows."""
    held, n = [], 0
    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            held.append(b)
            n += b.num_rows
        if n and (b is None or n >= PACK_ROWS):
            yield _packs(pa.Table.from_batches(held))
            held, n = [], 0


def output_schema(labels: list[str]) -> str:
    per = "".join(f"n_{w} long, a_{w} long, d_{w} long, " for w in labels)
    return ("ent string, eid string, transaction_id string, " + per
            + "n_all long, a_all long, gap_us long, prev_amt long, amt long, kept int")


class Events:
    """Events in time order, as columns."""

    def __init__(self, at=(), amt=(), merch=()) -> None:
        self.at, self.amt, self.merch = np.asarray(at, np.int64), np.asarray(amt, np.int64), list(merch)

    def __len__(self) -> int:
        return len(self.at)

    def merged(self, other: Events) -> tuple[Events, np.ndarray]:
        """Both in time order, own rows first among equals; and where the other's rows are.

        The other's rows come in time order.
        """
        if not len(self) or (len(other) and self.at[-1] <= other.at[0]):
            return (Events(np.concatenate([self.at, other.at]), np.concatenate([self.amt, other.amt]), self.merch + other.merch),
                    np.arange(len(self), len(self) + len(other)))
        at = np.concatenate([self.at, other.at])
        order = np.argsort(at, kind="stable")
        merch = self.merch + other.merch
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return Events(at[order], np.concatenate([self.amt, other.amt])[order], [merch[i] for i in order]), place[len(self):]

    def cut(self, first: int, last: int | None = None) -> Events:
        return Events(self.at[first:last], self.amt[first:last], self.merch[first:last])

    def before(self, points: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the events before each point (`side` left), or up to it (right)."""
        n = np.searchsorted(self.at, points, side)
        return n, np.concatenate([[0], np.cumsum(self.amt)])[n]


class Under:
    """The entries of one entity in a map that holds those of its group; keys begin with its id."""

    def __init__(self, state, eid: str, entries=None) -> None:
        self.state, self.eid, self.entries = state, eid, entries

    def getValue(self, key):  # noqa: N802
        return self.state.getValue((self.eid, *key))

    def containsKey(self, key):  # noqa: N802
        return self.state.containsKey((self.eid, *key))

    def updateValue(self, key, value):  # noqa: N802
        self.state.updateValue((self.eid, *key), value)

    def removeKey(self, key):  # noqa: N802
        self.state.removeKey((self.eid, *key))

    def iterator(self):
        """What `entries`, a function, found when the group's map was read once."""
        return iter(self.entries().get(self.eid, []))


class Pages:
    """The heads of a group's entities over the pages of a state map, read and written as a whole call needs them."""

    def __init__(self, state, count) -> None:
        self.state, self.count = state, count
        self.before = self.n = count.get()[0] if count.exists() else 1
        self.loaded: dict[int, dict[str, tuple]] = {}
        self.changed: set[int] = set()

    def _place(self, eid: str) -> int:
        return zlib.crc32(eid.encode()) & (self.n - 1)

    def _page(self, number: int) -> dict[str, tuple]:
        if number not in self.loaded:
            got = self.state.getValue((number,))
            self.loaded[number] = self.decoded(got[0]) if got else {}
        return self.loaded[number]

    def get(self, eid: str) -> tuple | None:
        return self._page(self._place(eid)).get(eid)

    def put(self, eid: str, value: tuple) -> None:
        number = self._place(eid)
        self._page(number)[eid] = value
        self.changed.add(number)

    def items(self) -> list[tuple[str, tuple]]:
        return [x for i in range(self.n) for x in self._page(i).items()]

    def write(self) -> None:
        while any(len(pg) > 1 and sum(1 + len(v[6]) for v in pg.values()) > PAGE_ROWS for pg in (self.loaded[i] for i in self.changed)):
            all_ = self.items()
            self.n *= 2
            self.loaded = {i: {} for i in range(self.n)}
            for eid, value in all_:
                self.put(eid, value)
            self.changed = set(self.loaded)
        for i in self.changed:
            self.state.updateValue((i,), (self.encoded(self.loaded[i]),))
        if self.n != self.before:
            self.count.update((self.n,))

    @staticmethod
    def encoded(page: dict[str, tuple]) -> bytes:
        values = list(page.values())
        ends = pa.array(np.cumsum([0, *(len(v[6]) for v in values)]), pa.int32())
        flat = [np.concatenate([np.zeros(0, np.int64), *(v[i] for v in values)]) for i in (6, 7)] + [[m for v in values for m in v[8]]]
        columns = [pa.array(list(page), pa.string())] + [pa.array([v[i] for v in values], _PAGE.field(i + 1).type) for i in range(6)]
        columns += [pa.ListArray.from_arrays(ends, pa.array(x, f.type.value_type)) for x, f in zip(flat, list(_PAGE)[7:], strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=_PAGE).serialize().to_pybytes()

    @staticmethod
    def decoded(data: bytes) -> dict[str, tuple]:
        b = pa.ipc.read_record_batch(pa.py_buffer(data), _PAGE)
        ends = b["at"].offsets.to_pylist()
        at, amt = (b[c].values.to_numpy() for c in ("at", "amt"))
        merch = b["merch"].values.to_numpy(zero_copy_only=False).tolist()
        plain = zip(*(b[c].to_pylist() for c in _PAGE.names[:7]), strict=True)
        return {eid: (*rest, at[lo:hi], amt[lo:hi], merch[lo:hi])
                for (eid, *rest), lo, hi in zip(plain, ends[:-1], ends[1:], strict=True)}


def page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ent, data) of stored pages as one row per entity."""
    for b in batches:
        for ent, data in zip(b["ent"].to_pylist(), b["data"].to_pylist(), strict=True):
            page = pa.ipc.read_record_batch(pa.py_buffer(data), _PAGE)
            yield pa.RecordBatch.from_arrays([pa.array([ent] * page.num_rows, pa.string()), *page.columns], names=["ent", *_PAGE.names])


class Spilled:
    """The events of one entity that left its head, by cell of time, over the state maps."""

    def __init__(self, minutes, chunks, seen, rows: int, cell: int) -> None:
        self.minutes, self.chunks, self.seen, self.rows, self.cell = minutes, chunks, seen, rows, cell
        #: cell -> [number, sum, merchants seen last in it, parts]; a window has a bounded number of cells.
        self.known: dict[int, list[int]] = {}
        self.changed: set[int] = set()
        self.loaded: dict[int, Events] = {}

    def read(self) -> None:
        self.known = {k[0]: list(v) for k, v in self.minutes.iterator()}

    def events(self, minute: int) -> Events:
        """All events of a cell, part by part."""
        if minute not in self.loaded:
            parts = [self.chunks.getValue((minute, n)) for n in range(self.known[minute][3])]
            at, amt = ([x for p in parts for x in p[i]] for i in (0, 1))
            found = Events()
            if at:
                order = np.argsort(at, kind="stable")
                merch = [x for p in parts for x in p[2]]
                found = Events(np.asarray(at, np.int64)[order], np.asarray(amt, np.int64)[order], [merch[i] for i in order])
            self.loaded[minute] = found
        return self.loaded[minute]

    def _totals(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(self.known)
        return np.array(order, np.int64), np.concatenate([[0], np.cumsum([self.known[m][which] for m in order])]).astype(np.int64)

    def _runs(self, minute: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The places of each known cell; the cells come in order, so each is one run."""
        values, first, n = np.unique(minute, return_index=True, return_counts=True)
        for m, i, k in zip(values.tolist(), first.tolist(), n.tolist(), strict=True):
            if m in self.known:
                yield m, slice(i, i + k)

    def before(self, points: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
        order, n = self._totals(0)
        _, a = self._totals(1)
        minute = points // self.cell
        at = np.searchsorted(order, minute, "left")
        count, total = n[at], a[at]
        for m, own in self._runs(minute):
            some, money = self.events(m).before(points[own], side)
            count[own] += some
            total[own] += money
        return count, total

    def newest(self) -> int | None:
        if not self.known:
            return None
        return int(self.events(max(self.known)).at[-1])

    def seen_since(self, points: np.ndarray) -> np.ndarray:
        """Merchants whose newest event here is at each point or later."""
        order, d = self._totals(2)
        minute = points // self.cell
        count = d[-1] - d[np.searchsorted(order, minute, "right")]
        for m, own in self._runs(minute):
            got = self.events(m)
            last = dict(zip(got.merch, got.at.tolist(), strict=True))  # in time order, so the last one stays
            here = np.sort([x for k, x in last.items() if k and self.last_seen(k) == x])
            count[own] += len(here) - np.searchsorted(here, points[own], "left")
        return count

    def last_seen(self, merchant: str) -> int | None:
        got = self.seen.getValue((merchant,)) if self.seen.containsKey((merchant,)) else None
        return got[0] if got else None

    def merchants_between(self, first: int, last: int) -> set[str]:
        out: set[str] = set()
        for m in [m for m in self.known if first // self.cell <= m <= last // self.cell]:
            got = self.events(m)
            out.update(got.merch[np.searchsorted(got.at, first, "left"):np.searchsorted(got.at, last, "right")])
            self.loaded.pop(m)  # one cell at a time
        return out

    def add(self, rows: Events, distinct: bool) -> None:
        """Append rows to their cells, filling the last part before a new one begins."""
        minute = rows.at // self.cell
        for m in np.unique(minute).tolist():
            own = rows.cut(int(np.searchsorted(minute, m, "left")), int(np.searchsorted(minute, m, "right")))
            entry = self.known.setdefault(m, [0, 0, 0, 0])
            at, amt, merch = own.at.tolist(), own.amt.tolist(), own.merch
            if entry[0] % self.rows:
                last = self.chunks.getValue((m, entry[3] - 1))
                entry[3] -= 1
                at, amt, merch = list(last[0]) + at, list(last[1]) + amt, list(last[2]) + merch
            for i in range(0, len(at), self.rows):
                to = i + self.rows
                self.chunks.updateValue((m, entry[3]), (at[i:to], amt[i:to], merch[i:to]))
                entry[3] += 1
            entry[0] += len(own)
            entry[1] += int(own.amt.sum())
            self.changed.add(m)
            self.loaded.pop(m, None)
        if distinct:
            newest = {k: int(x) for k, x in zip(rows.merch, rows.at.tolist(), strict=True) if k}
            for k, x in newest.items():
                old = self.last_seen(k)
                if old is None or x > old:
                    if old is not None and old // self.cell in self.known:
                        self.known[old // self.cell][2] -= 1
                        self.changed.add(old // self.cell)
                    self.known[x // self.cell][2] += 1
                    self.seen.updateValue((k,), (x,))

    def drop_before(self, horizon: int, distinct: bool) -> None:
        """Remove the cells that end before `horizon`."""
        for m in [m for m in self.known if (m + 1) * self.cell <= horizon]:
            if distinct:
                for k in {*self.events(m).merch} - {""}:
                    if (last := self.last_seen(k)) is not None and last // self.cell == m:
                        self.seen.removeKey((k,))
            for n in range(self.known[m][3]):
                self.chunks.removeKey((m, n))
            self.minutes.removeKey((m,))
            self.loaded.pop(m, None)
            self.changed.discard(m)
            del self.known[m]

    def write(self) -> None:
        for m in self.changed:
            self.minutes.updateValue((m,), tuple(int(x) for x in self.known[m]))


def distinct_before(rows: Events, places: np.ndarray, span: int, old: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each place in `rows`: distinct merchants before it within `span`, and how many of them `old` has in the span too.

    `old` is when a merchant was seen last outside of `rows`. Two pointers visit each
    row twice; window starts only move on, so a merchant leaves by age once.
    """
    out, both = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    inside: Counter = Counter()
    shared: set[str] = set()
    ages: list[tuple[int, str]] = []
    lo, wanted = 0, {int(p): n for n, p in enumerate(places)}
    for i in range(int(places.max()) + 1):
        start = int(rows.at[i]) - span
        while lo < i and rows.at[lo] < start:
            m = rows.merch[lo]
            if m:
                inside[m] -= 1
                if not inside[m]:
                    del inside[m]
                    shared.discard(m)
            lo += 1
        while ages and ages[0][0] < start:
            shared.discard(heapq.heappop(ages)[1])
        if i in wanted:
            out[wanted[i]], both[wanted[i]] = len(inside), len(shared)
        if m := rows.merch[i]:
            if not inside[m] and old.get(m, start - 1) >= start:
                shared.add(m)
                heapq.heappush(ages, (old[m], m))
            inside[m] += 1
    return out, both


class EntityWindows(StatefulProcessor):
    """Windows and priors of one entity, or of the entities of one group."""

    def __init__(self, entities: tuple[C.Entity, ...] = C.CATALOGUE, ttl_seconds: int | None = None,
                 rows: int = ROWS, lateness_us: int | None = None, grouped: bool = False,
                 cell: int = MINUTE) -> None:
        self.labels = list(dict.fromkeys(w.label for e in entities for w in e.windows))
        self.spans = {w: C.WINDOW_SECONDS[w] * MICRO for w in self.labels}
        self.longest = max(self.spans.values(), default=0)
        self.distinct = {e.name: [w.label for w in e.windows if w.distinct] for e in entities}
        self.ttl_ms = ttl_seconds * 1000 if ttl_seconds else None
        self.rows, self.lateness, self.timed, self.grouped = rows, lateness_us or 0, lateness_us is not None, grouped
        self.cell, self.paged = cell, grouped and not ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        id_ = "eid string, " if self.grouped else ""
        if self.paged:
            self.head, self.pages = handle.getMapState("head", "page int", "data binary"), handle.getValueState("pages", "n int")
        elif self.grouped:
            self.head = handle.getMapState("head", "eid string", HEAD_SCHEMA, self.ttl_ms)
        else:
            self.head = handle.getValueState("head", HEAD_SCHEMA, self.ttl_ms)
        self.maps = (handle.getMapState("minutes", f"{id_}minute long", MINUTE_SCHEMA, self.ttl_ms),
                     handle.getMapState("chunks", f"{id_}minute long, part int", _EVENTS, self.ttl_ms),
                     handle.getMapState("seen", f"{id_}merchant string", "at long", self.ttl_ms))
        if self.grouped and self.timed:
            self.due = handle.getValueState("due", "at long")

    def _group_minutes(self) -> dict[str, list]:
        """The minutes of all entities of the group, read when the first of them has any."""
        if self.read_minutes is None:
            self.read_minutes = {}
            for (eid, minute), v in self.maps[0].iterator():
                self.read_minutes.setdefault(eid, []).append(((minute,), v))
        return self.read_minutes

    def _state(self, eid: str, value=None) -> tuple:
        """Priors, the timer, the head's events, and the spilled ones."""
        if value is None:
            value = (self.heads.get(eid) if self.paged else self.head.getValue((eid,)) if self.grouped
                     else self.head.get() if self.head.exists() else None)
        n, a, prev_at, prev_amt, has, due, at, amt, merch = value or (0, 0, None, None, False, None, [], [], [])
        maps = self.maps if not self.grouped else [Under(m, eid, self._group_minutes) for m in self.maps]
        spilled = Spilled(*maps, self.rows, self.cell)
        if has:
            spilled.read()
        return (n, a, prev_at, prev_amt), due, Events(at, amt, merch), spilled

    def _commit(self, ent: str, eid: str, priors: tuple, due: int | None, events: Events, spilled: Spilled, horizon: int) -> tuple[int, int | None]:
        """Drop what no window reaches and move what the head cannot hold; the number of events left, and when the oldest can go."""
        distinct = bool(self.distinct.get(ent))
        events = events.cut(int(np.searchsorted(events.at, horizon, "left")))
        spilled.drop_before(horizon, distinct)
        if len(events) > self.rows:
            spilled.add(events.cut(0, len(events) - self.rows // 2), distinct)
            events = events.cut(len(events) - self.rows // 2)
        spilled.write()
        kept = len(events)
        if spilled.known:
            kept += sum(v[0] for v in spilled.known.values()) - int(spilled.before(np.array([horizon]), "left")[0][0])
        wanted = None
        if self.timed:
            oldest = min([int(x) // self.cell for x in events.at[:1]] + list(spilled.known), default=None)
            wanted = None if oldest is None else ((oldest + 1) * self.cell + self.longest) // 1000 + 1
            if not self.grouped and wanted is not None and due is None:
                self.handle.registerTimer(wanted)
                due = wanted
        if self.paged:
            self.heads.put(eid, (*priors, bool(spilled.known), due, events.at, events.amt, events.merch))
            return kept, wanted
        value = (*priors, bool(spilled.known), due, events.at.tolist(), events.amt.tolist(), events.merch)
        if self.grouped:
            self.head.updateValue((eid,), value)
        else:
            self.head.update(value)
        return kept, wanted

    def _schedule(self, wanted: list[int | None], due: int | None) -> None:
        """One timer a group, at the earliest time that an entity of it asks for."""
        first = min((w for w in wanted if w is not None), default=None)
        if first is not None and (due is None or first < due):
            self.handle.registerTimer(first)
            self.due.update((first,))

    def _begin(self) -> None:
        self.read_minutes = None
        if self.paged:
            self.heads = Pages(self.head, self.pages)

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
        """Ids, transactions, times, amounts and merchants of the rows: entity by entity, in time order."""
        frames = list(rows)
        if "pack" in frames[0]:
            t = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(p), _PACKED) for f in frames for p in f["pack"]])
            new = {c: t[c].to_numpy() for c in _PACKED.names}
        else:
            f = pd.concat(frames, ignore_index=True)
            new = {c: f[c].to_numpy() for c in _PACKED.names}
        ids, at, seq = pd.factorize(new["eid"])[0], new["at"].astype(np.int64), new["seq"]
        order = np.lexsort((seq, at, ids))
        same = [x[order][1:] == x[order][:-1] for x in (ids, at, seq)]
        if np.logical_and.reduce(same).any():
            order = np.lexsort((new["transaction_id"], seq, at, ids))
        return (new["eid"][order], new["transaction_id"][order], at[order], new["amt"].astype(np.int64)[order], new["merch"][order].tolist())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._begin()
        ent, (ids, transactions, t, amt, merch) = key[0], self._in_order(rows)
        starts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        got, wanted = [], []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            columns, when = self._entity(ent, ids[lo], Events(t[lo:hi], amt[lo:hi], merch[lo:hi]))
            got.append(columns)
            wanted.append(when)
        if self.paged:
            self.heads.write()
        if self.grouped and self.timed:
            self._schedule(wanted, self.due.get()[0] if self.due.exists() else None)
        out = {"ent": ent, "eid": ids, "transaction_id": transactions}
        out |= {c: np.concatenate([g[c] for g in got]) for c in got[0] if c != "known"}
        unknown = ~np.concatenate([g["known"] for g in got])
        for c in ("gap_us", "prev_amt"):
            out[c] = pd.arrays.IntegerArray(out[c], unknown)
        yield pd.DataFrame(out)

    def _entity(self, ent: str, eid: str, new: Events) -> tuple[dict[str, np.ndarray], int | None]:
        """The output columns of one entity's rows, which come in order."""
        (n0, a0, prev_at, prev_amt), due, head, spilled = self._state(eid)
        t, amt = new.at, new.amt
        events, place = head.merged(new)
        k, order = len(t), np.arange(len(t))
        out = {}
        sums = np.concatenate([[0], np.cumsum(events.amt)])
        newest = spilled.newest()
        late = np.zeros(k, bool) if newest is None else t < newest
        old = {}
        if newest is not None and self.distinct.get(ent):
            old = {m: x for m in {*events.merch} - {""} if (x := spilled.last_seen(m)) is not None}
        if newest is not None:
            n_to, a_to = spilled.before(t, "right")
        for w in self.labels:
            start = t - self.spans[w]
            lo = np.searchsorted(events.at, start, "left")
            out[f"n_{w}"], out[f"a_{w}"] = place - lo, sums[place] - sums[lo]
            d = np.zeros(k, np.int64)
            if w in self.distinct.get(ent, []):
                d, both = distinct_before(events, place, self.spans[w], old)
                if newest is not None:
                    d += spilled.seen_since(start) - both
                    for i in np.flatnonzero(late):  # rows older than what was spilled look at the events themselves
                        seen = spilled.merchants_between(int(start[i]), int(t[i])) | set(events.merch[lo[i]:place[i]])
                        d[i] = len(seen - {""})
            if newest is not None:
                n_from, a_from = spilled.before(start, "left")
                out[f"n_{w}"] += n_to - n_from
                out[f"a_{w}"] += a_to - a_from
            out[f"d_{w}"] = d
        out["known"] = np.ones(k, dtype=bool)
        out["known"][0] = prev_at is not None
        money = np.concatenate([[0], np.cumsum(amt)])
        out["n_all"], out["a_all"] = n0 + order, a0 + money[:-1]
        out["gap_us"] = np.maximum(t - np.concatenate([[prev_at if prev_at is not None else -1], t[:-1]]), 0)
        out["prev_amt"] = np.concatenate([[prev_amt if prev_amt is not None else 0], amt[:-1]]).astype(np.int64)
        out["amt"] = amt
        # Nothing older than the longest window of the oldest event that may still come is needed again.
        priors = int(n0 + k), int(a0 + money[-1]), int(t[-1]), int(amt[-1])
        coming = int(t[-1]) if not self.timed else int(t[-1]) // 1000 * 1000 - self.lateness
        kept, wanted = self._commit(ent, eid, priors, due, events, spilled, coming - self.longest)
        out["kept"] = np.full(k, kept)
        return out, wanted

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The watermark has passed an oldest minute and the longest window: drop what no event can reach."""
        self._begin()
        horizon = timerValues.getCurrentWatermarkInMs() * 1000 - self.longest
        if not self.grouped:
            priors, _, head, spilled = self._state(key[1])
            self._commit(key[0], key[1], priors, None, head, spilled, horizon)
        elif self.due.exists() and self.due.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            wanted = []
            for eid, value in self.heads.items():
                if value[4] or len(value[6]):  # it has cells, or events in its head
                    priors, due, head, spilled = self._state(eid, value)
                    wanted.append(self._commit(key[0], eid, priors, due, head, spilled, horizon)[1])
            self.heads.write()
            self.due.clear()
            self._schedule(wanted, None)
        yield from ()

    def close(self) -> None:
        pass


def entity_features(txn_stream: DataFrame, entities: tuple[C.Entity, ...] = C.CATALOGUE,
                    ttl_seconds: int | None = None, rows: int = ROWS, lateness: str | None = None,
                    parts: int | None = None, cell_minutes: int = 1) -> DataFrame:
    """Stateful stage: one output row per event and entity, append mode.

    `ttl_seconds` (for example the longest window plus an hour) lets idle
    entities expire; then their cumulative priors restart. `lateness` (such as
    "2 days") sets a watermark on the event time: events later than that are
    dropped, and timers empty the windows of entities that fall silent, while
    their priors stay. Entities without windows keep priors alone. `rows` bounds the events in a state value. `parts` deals
    the entities of each kind over so many groups, each served by one call a batch;
    like the state's pieces it is fixed for the life of a checkpoint, and so is
    `cell_minutes`, the time that events which left a head are kept by.
    """
    if ttl_seconds and lateness:
        raise ValueError("expiry goes by processing time or by event time, not both")
    late_us = int(pd.Timedelta(lateness).value // 1000) if lateness else None
    proc = EntityWindows(entities, ttl_seconds, rows, late_us, parts is not None, cell_minutes * MINUTE)
    source = txn_stream.withWatermark("event_time", lateness) if lateness else txn_stream
    mode = "processingTime" if ttl_seconds else "eventTime" if lateness else "none"
    each = entity_rows(source, entities)
    each = each if parts is None else each.withColumn("part", F.pmod(F.xxhash64("eid"), F.lit(parts)))
    if parts is not None and not lateness:
        each = each.select("ent", "part", *_PACKED.names).mapInArrow(pack_rows, "ent string, part long, pack binary")
    return each.groupBy("ent", "eid" if parts is None else "part").transformWithStateInPandas(
        proc, output_schema(proc.labels), "append", mode)


def read_state(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """The state a finished stream left behind: (ent, eid, n, prev_at) of every entity, and (ent, eid, at, amt) of its events."""

    def variable(name: str) -> DataFrame:
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()

    head, chunks = variable("head"), variable("chunks")
    grouped = "user_map_value" in head.columns
    if not grouped:
        head = head.select("key.*", "value.*")
    elif "data" in head.schema["user_map_value"].dataType.names:
        head = head.select("key.ent", "user_map_value.data").mapInArrow(page_rows, f"ent string, eid string, {HEAD_SCHEMA}")
    else:
        head = head.select("key.ent", "user_map_key.eid", "user_map_value.*")
    eid = "user_map_key.eid" if grouped else "key.eid"
    chunks = chunks.select("key.ent", eid, F.col("user_map_value").alias("v")).select("ent", "eid", "v.*")
    both = head.select("ent", "eid", "at", "amt", "merch").unionByName(chunks)
    each = both.select("ent", "eid", F.explode(F.arrays_zip("at", "amt")).alias("e")).select("ent", "eid", "e.*")
    return head.select("ent", "eid", "n", "prev_at"), each


def widen(long: DataFrame, entities: tuple[C.Entity, ...] = C.CATALOGUE) -> DataFrame:
    """Entity rows of each event as one feature row, named as in the batch form."""
    prior = {
        "txn_count_prior": F.col("n_all").cast("double"),
        "amount_mean_prior": F.when(F.col("n_all") > 0, F.col("a_all") / C.MONEY_SCALE / F.col("n_all")).otherwise(0.0),
        "time_since_prev_log": F.when(F.col("gap_us").isNotNull(), F.log1p(F.col("gap_us") / F.lit(1e6))).otherwise(0.0),
        "prev_amount_ratio": F.when(F.col("prev_amt") > 0, F.least(F.greatest(
            F.col("amt") / F.col("prev_amt"), F.lit(0.0)), F.lit(50.0))).otherwise(1.0),
    }
    values = {}
    for e in entities:
        own = F.col("ent") == e.name
        for w in e.windows:
            values[f"{e.name}_v_{w.label}_count"] = F.max(F.when(own, F.col(f"n_{w.label}").cast("double")))
            if w.amount:
                values[f"{e.name}_v_{w.label}_amount"] = F.max(F.when(own, F.col(f"a_{w.label}") / F.lit(float(C.MONEY_SCALE))))
            if w.distinct:
                values[f"{e.name}_v_{w.label}_distinct_merchants"] = F.max(F.when(own, F.col(f"d_{w.label}").cast("double")))
        for p in e.priors:
            values[f"{e.name}_{p}"] = F.max(F.when(own, prior[p]))
    names = C.velocity_feature_names(entities) + C.prior_feature_names(entities)
    return long.groupBy("transaction_id").agg(*[values[n].alias(n) for n in names])
