"""Document repository, unit of work and batch writer.

Every write appends a version; the present document of an id is its greatest
version, the others are its history.  Expected versions are checked against the
state the commit is made on.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DocVersionConflict, NotFound, ValidationFailed
from ..functions import jsonpath
from ..plans import event_ops
from ..plans.query import Collection, CompiledQuery, DocumentQuery
from ..sources.commitlog import Change, Facts, Part, State
from ..store import DOCS, MAX_KEYS, Store, key_of, may_hold, now
from .upcasting import with_fields

_KEY = ["tenant_id", "id"]


def set_path(doc: Any, path: jsonpath.Path, value: Any) -> Any:
    """doc with the value at a path; missing parents become objects, siblings stay."""
    segments = jsonpath.parse(path)
    if not segments:
        return value
    head, rest = segments[0], segments[1:]
    if isinstance(doc, list) and head.isdigit():
        out, i = list(doc), int(head)
        if i < len(out):
            out[i] = set_path(out[i], rest, value)
        else:
            out.append(set_path(None, rest, value))
        return out
    out = dict(doc) if isinstance(doc, dict) else {}
    out[head] = set_path(out.get(head), rest, value)
    return out


class Documents:
    def __init__(self, store: Store, tenant: str | None = None, user: str | None = None):
        self.store, self._tenant, self.user = store, tenant, user

    def for_tenant(self, tenant: str) -> Documents:
        return Documents(self.store, tenant, self.user)

    # --- reads -----------------------------------------------------------------
    def versions(self) -> DataFrame:
        return self.store.scan("docs", self._tenant)

    def current(self) -> DataFrame:
        """The present row of every id that was not removed for good."""
        found = event_ops.latest(self.versions(), _KEY)
        return found.where("op <> 'DELETE'")

    def history(self) -> DataFrame:
        return event_ops.superseded(self.versions(), _KEY)

    def collection(self, promoted: dict[str, tuple[str, str]] | None = None) -> Collection:
        """promoted: path -> (type, transform template of {value})."""
        frame, names = self.current(), {p.path: p.column for p in self.store.promoted}
        kept = ("docs_search", self.store.search) if self.store.search else None
        for i, (path, (kind, template)) in enumerate((promoted or {}).items()):
            name = f"promoted_{i}"
            text = jsonpath.text(F.col("doc"), path)
            frame = frame.withColumn("__value", text.cast(kind)).withColumn(name, F.expr(template.replace("{value}", "__value"))).drop("__value")
            names[path] = name
        return Collection(frame, "id", "doc", "deleted_at", None, names, lexemes_col=kept)

    def query(self, promoted: dict[str, tuple[str, str]] | None = None) -> DocumentQuery:
        return DocumentQuery(self.collection(promoted))

    def execute_compiled(self, query: CompiledQuery) -> list:
        return query.on(self.collection()).fetch_all()

    def _row(self, id_: str, state: State | None = None, value: Column | None = None):
        """The last version of an id, with its document as `json` (or `value` in its
        place); only folders that may hold the id are opened."""
        own, log = self.store.row_tenant(self._tenant), self.store.log(self._tenant)
        folders = log.folders("docs", state, may_hold(key_of(own, id_)))
        if not folders:
            return None
        frame = log.read_folders("docs", folders).where(F.col("id") == str(id_))
        if own is not None:
            frame = frame.where(F.col("tenant_id") == own)
        row = frame.orderBy(F.desc("version")).select(*[c for c in DOCS.names if c != "doc"], (F.to_json("doc") if value is None else value).alias("json")).first()
        return None if row is None or row.op == "DELETE" else row

    def _rows(self, ids: list[str], state: State) -> dict[str, Any]:
        """The last versions of some ids, by one job."""
        own, log = self.store.row_tenant(self._tenant), self.store.log(self._tenant)
        keys = [key_of(own, i) for i in ids]
        folders = log.folders("docs", state, lambda facts: any(may_hold(k)(facts) for k in keys))
        if not ids or not folders:
            return {}
        frame = log.read_folders("docs", folders).where(F.col("id").isin(ids))
        if own is not None:
            frame = frame.where(F.col("tenant_id") == own)
        last = frame.select(*[c for c in DOCS.names if c != "doc"], F.to_json("doc").alias("json")).groupBy("id").agg(F.max_by(F.struct(*[c for c in DOCS.names if c not in ("doc", "id")], "json"), "version").alias("r"))
        found = last.select("id", "r.*").collect()  # a row for each of the ids
        return {r.id: r for r in found if r.op != "DELETE"}

    def get(self, id_: str) -> tuple[Any, int] | None:
        """(document, version), or None if it is missing or soft-deleted."""
        self.store.metrics.add("doc_reads", tenant=self._tenant)
        row = self._row(id_)
        return None if row is None or row.deleted_at is not None else (json.loads(row.json), row.version)

    def get_with_metadata(self, id_: str) -> tuple[Any, dict] | None:
        row = self._row(id_)
        if row is None or row.deleted_at is not None:
            return None
        return json.loads(row.json), {k: row[k] for k in ("id", "version", "created_at", "updated_at", "deleted_at", "created_by", "last_modified_by")}

    def get_field(self, id_: str, path: str) -> Any:
        """One field; soft-deleted documents are read as well."""
        row = self._row(id_, value=F.to_json(jsonpath.value(F.col("doc"), path)))
        return None if row is None or row.json is None else json.loads(row.json)

    # --- writes ----------------------------------------------------------------
    def _new(self, id_: str, doc: Any, old: Any, op: str = "UPDATE", deleted_at: Any = "keep") -> tuple:
        at = now()
        version = old.version + 1 if old else 1
        gone = (old.deleted_at if old else None) if deleted_at == "keep" else deleted_at
        return (self.store.row_tenant(self._tenant), str(id_), json.dumps(doc), version, old.created_at if old else at, at, gone, old.created_by if old else self.user, self.user, op if old else "INSERT")

    def _write(self, id_: str, make: Callable[[Any], tuple | None]) -> int:
        """make(old row) returns the new row; the version is returned."""
        seen = {}

        def change(state: State) -> Change | None:
            row = make(self._row(id_, state))
            seen["row"] = row
            return None if row is None else Change(add={"docs": self.store.part([row], "docs", "id")})

        try:
            self.store.commit(change, self._tenant)
        except DocVersionConflict:
            self.store.metrics.add("doc_conflicts", tenant=self._tenant)
            raise
        self.store.metrics.add("doc_writes", tenant=self._tenant)
        return seen["row"][3] if seen["row"] else 0

    def upsert(self, id_: str, doc: Any) -> int:
        return self._write(id_, lambda old: self._new(id_, doc, old))

    def put(self, id_: str, doc: Any, expected: int | None = None) -> int:
        """An upsert; with an expected version the document must be there with it."""

        def make(old):
            if expected is not None and (old is None or old.deleted_at is not None or old.version != expected):
                raise DocVersionConflict(f"{id_}: expected version {expected}, found {old.version if old else None}")
            return self._new(id_, doc, old)

        return self._write(id_, make)

    def update(self, id_: str, mutate: Callable[[Any], Any], expected: int | None = None) -> int:
        def make(old):
            if old is None or old.deleted_at is not None:
                raise NotFound(f"no document {id_}")
            if expected is not None and old.version != expected:
                raise DocVersionConflict(f"{id_}: expected version {expected}, found {old.version}")
            return self._new(id_, mutate(json.loads(old.json)), old)

        return self._write(id_, make)

    def patch_fields(self, id_: str, fields: list[tuple[jsonpath.Path, Any]], expected: int | None = None) -> int:
        if not fields:
            found = self.get(id_)
            if found is None:
                raise NotFound(f"no document {id_}")
            return found[1]

        def mutate(doc):
            for path, value in fields:
                doc = set_path(doc, path, value)
            return doc

        return self.update(id_, mutate, expected)

    def patch(self, id_: str, path: jsonpath.Path, value: Any, expected: int | None = None) -> int:
        return self.patch_fields(id_, [(path, value)], expected)

    def _flag(self, id_: str, at: Any) -> int:
        def make(old):
            if old is None:
                raise NotFound(f"no document {id_}")
            return self._new(id_, json.loads(old.json), old, deleted_at=at)

        return self._write(id_, make)

    def soft_delete(self, id_: str) -> int:
        return self._flag(id_, now())

    def restore(self, id_: str) -> int:
        return self._flag(id_, None)

    # --- bulk ------------------------------------------------------------------
    def _items(self, items: list[tuple]) -> DataFrame:
        wide = len(items[0]) > 2
        rows = [(str(i[0]), json.dumps(i[1]), int(i[2]) if wide else None) for i in items]
        return self.store.spark.createDataFrame(rows, "id string, json string, expected int")

    def _joined(self, state: State, items: DataFrame) -> DataFrame:
        """Items with the present row of their id, by one join."""
        frame = self.store.log(self._tenant).read("docs", state)
        own = self.store.row_tenant(self._tenant)
        if own is not None:
            frame = frame.where(F.col("tenant_id") == own)
        present = event_ops.latest(frame.select(*[c for c in DOCS.names if c != "doc"]), _KEY).where("op <> 'DELETE'")
        return items.join(event_ops.dealt(present), "id", "left")

    def _bulk_rows(self, joined: DataFrame, op: str) -> DataFrame:
        at, own = F.current_timestamp(), F.lit(self.store.row_tenant(self._tenant)).cast("string")
        user = F.lit(self.user).cast("string")
        rows = joined.select(own.alias("tenant_id"), "id", F.parse_json("json").alias("doc"), (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version"), F.coalesce("created_at", at).alias("created_at"), at.alias("updated_at"), "deleted_at", F.coalesce("created_by", user).alias("created_by"), user.alias("last_modified_by"), F.when(F.col("version").isNull(), F.lit("INSERT")).otherwise(F.lit(op)).alias("op"))
        return self.store.with_kept(rows)

    def _bulk_part(self, rows: DataFrame, ids: list[str] | None = None) -> Part:
        facts: Facts = self.store.kept_facts()
        if ids is not None and len(ids) <= MAX_KEYS:
            facts["keys"] = {key_of(self.store.row_tenant(self._tenant), i): 0 for i in ids}
        return Part(rows, facts, {"parquet.bloom.filter.enabled#id": "true"} if ids is None else {})

    def bulk_upsert(self, items: list[tuple[str, Any]]) -> int:
        """Affected documents; of repeated ids the last counts."""
        if not items:
            return 0
        items = list({str(i): (i, d) for i, d in items}.values())
        frame, ids = self._items(items), [str(i) for i, _ in items]
        self.store.commit(lambda s: Change(add={"docs": self._bulk_part(self._bulk_rows(self._joined(s, frame), "UPDATE"), ids)}), self._tenant)
        return len(items)

    def upsert_frame(self, items: DataFrame) -> None:
        """Upserts all rows of id, json (text); of a repeated id the greatest text counts."""
        items = items.groupBy(F.col("id").cast("string").alias("id")).agg(F.max("json").alias("json"))
        self.store.commit(lambda s: Change(add={"docs": self._bulk_part(self._bulk_rows(self._joined(s, items), "UPDATE"))}), self._tenant)

    def update_frame(self, items: DataFrame) -> None:
        """Updates from id, json, expected those documents that have the expected version;
        the others are left as they are.  versions() tells which."""
        items = items.select(F.col("id").cast("string").alias("id"), "json", F.col("expected").cast("int").alias("expected"))
        self.store.commit(lambda s: Change(add={"docs": self._bulk_part(self._bulk_rows(self._joined(s, items).where("version = expected"), "UPDATE"))}), self._tenant)

    def delete_frame(self, ids: DataFrame) -> None:
        """Removes the documents of all rows of id."""
        items = ids.select(F.col("id").cast("string").alias("id"), F.lit("null").alias("json")).distinct()
        self.store.commit(lambda s: Change(add={"docs": self._bulk_part(self._bulk_rows(self._joined(s, items).where("version is not null"), "DELETE"))}), self._tenant)

    def patch_frame(self, ids: DataFrame, fields: dict[str, Any]) -> None:
        """Sets top-level fields (columns of ids, or values) of the documents of id."""
        names = list(fields)

        def change(state: State) -> Change:
            frame = self.store.log(self._tenant).read("docs", state)
            own = self.store.row_tenant(self._tenant)
            if own is not None:
                frame = frame.where(F.col("tenant_id") == own)
            present = event_ops.latest(frame.select(*DOCS.names), _KEY).where("op <> 'DELETE' and deleted_at is null")
            wanted = ids.select(F.col("id").cast("string").alias("id"), *[(v if isinstance(v, Column) else F.lit(v)).alias(f"__{i}") for i, v in enumerate(fields.values())])
            doc = with_fields(F.col("doc"), {n: F.col(f"__{i}") for i, n in enumerate(names)})
            rows = present.join(wanted, "id").withColumns({"doc": doc, "version": (F.col("version") + 1).cast("int"), "updated_at": F.current_timestamp(), "last_modified_by": F.lit(self.user).cast("string"), "op": F.lit("UPDATE")})
            return Change(add={"docs": self._bulk_part(self.store.with_kept(rows.select(*DOCS.names)))})

        self.store.commit(change, self._tenant)

    def bulk_update_expected(self, items: list[tuple[str, Any, int]]) -> tuple[int, int]:
        """(updated, conflicts)."""
        if not items:
            return 0, 0
        frame, seen = self._items(items), {}

        def change(state):
            versions = self._joined(state, frame).where("version = expected").select("id").collect()  # some of the items
            seen["n"] = len(versions)
            fit = self._joined(state, frame.where(F.col("id").isin([r.id for r in versions])))
            return Change(add={"docs": self._bulk_part(self._bulk_rows(fit, "UPDATE"), [r.id for r in versions])}) if versions else None

        self.store.commit(change, self._tenant)
        return seen["n"], len(items) - seen["n"]

    def bulk_delete(self, ids: list[str]) -> int:
        if not ids:
            return 0
        frame, seen = self._items([(i, None) for i in dict.fromkeys(map(str, ids))]), {}

        def change(state):
            there = self._joined(state, frame).where("version is not null")
            seen["n"] = there.count()
            return Change(add={"docs": self._bulk_part(self._bulk_rows(there, "DELETE"), list(dict.fromkeys(map(str, ids))))}) if seen["n"] else None

        self.store.commit(change, self._tenant)
        return seen["n"]


class BatchWriter:
    """Buffers writes; flush() upserts (last of an id wins), then updates with
    expected versions, then deletes, each in a commit of its own."""

    def __init__(self, documents: Documents):
        self.documents = documents
        self._upserts, self._updates, self._deletes = {}, [], []

    def upsert(self, id_: str, doc: Any) -> BatchWriter:
        self._upserts[str(id_)] = doc
        return self

    def update_expected(self, id_: str, doc: Any, version: int) -> BatchWriter:
        self._updates.append((id_, doc, version))
        return self

    def delete(self, id_: str) -> BatchWriter:
        self._deletes.append(id_)
        return self

    def flush(self) -> dict[str, int]:
        upserted = self.documents.bulk_upsert(list(self._upserts.items()))
        updated, conflicts = self.documents.bulk_update_expected(self._updates)
        deleted = self.documents.bulk_delete(self._deletes)
        self._upserts, self._updates, self._deletes = {}, [], []
        return {"upserted": upserted, "updated": updated, "conflicts": conflicts, "deleted": deleted}


class DocumentSession:
    """Unit of work: documents, events and snapshots staged here are committed by
    save_changes() in one log entry, or none of them is."""

    def __init__(self, store: Store, context):
        self.store, self.context = store, context
        self._known: dict[str, tuple[Any, int] | None] = {}
        self.clear()

    def clear(self) -> None:
        self._staged: dict[str, tuple] = {}
        self._events: list[tuple] = []
        self._snapshots: list[tuple] = []
        self._aggregates: list[tuple] = []

    def _documents(self) -> Documents:
        return Documents(self.store, self.context.tenant, self.context.user_id)

    def load(self, id_: str) -> Any | None:
        """The document as this session sees it; read once."""
        id_ = str(id_)
        if id_ in self._staged:
            kind, doc, _ = self._staged[id_]
            return None if kind == "delete" else doc
        if id_ not in self._known:
            self._known[id_] = self._documents().get(id_)
        return self._known[id_][0] if self._known[id_] else None

    def store_doc(self, id_: str, doc: Any, expected: int | None = None) -> None:
        self._staged[str(id_)] = ("store", doc, expected)

    def delete(self, id_: str, expected: int | None = None) -> None:
        self._staged[str(id_)] = ("delete", None, expected)

    def append_events(self, stream_id: str, events: list, expected: Any = None, context=None) -> None:
        """Staged events; the context of the call goes over the session's."""
        self._events.append((str(stream_id), list(events), expected, self.context.merged(context)))

    def snapshot(self, stream_id: str, version: int, body: Any) -> None:
        self._snapshots.append((str(stream_id), version, body))

    def aggregates(self, validator: Callable[[Any], str | None] | None = None) -> SessionAggregates:
        """Aggregates whose events are saved with this session's other changes."""
        return SessionAggregates(self, validator)

    def enqueue_aggregate(self, stream_id: str, agg: Any, events: list, snapshot: bool = False) -> None:
        """Stages events of an aggregate, expected at its version; its state and version
        move on when they are saved."""
        self.append_events(stream_id, events, agg.version)
        self._aggregates.append((str(stream_id), agg, list(events), snapshot))

    def save_changes(self) -> None:
        docs, writer = self._documents(), self.store.events()
        saved: dict[str, tuple[Any, int] | None] = {}
        moved: list[tuple] = []

        def change(state: State) -> Change | None:
            rows, saved_now, known = [], {}, docs._rows(list(self._staged), state)
            for id_, (kind, doc, expected) in self._staged.items():
                old = known.get(id_)
                if expected is not None and (old is None or old.deleted_at is not None or old.version != expected):
                    raise DocVersionConflict(f"{id_}: expected version {expected}, found {old.version if old else None}")
                if kind == "delete":
                    if old is not None:
                        rows.append(docs._new(id_, None, old, "DELETE"))
                    saved_now[id_] = None
                else:
                    rows.append(docs._new(id_, doc, old))
                    saved_now[id_] = (doc, rows[-1][3])
            out = Change()
            if rows:
                out.add["docs"] = self.store.part(rows, "docs", "id")
            if self._events:
                writer.stage(state, self._events, out)
            folded = []
            for stream, agg, events, snapshot in self._aggregates:
                body, version = next(((b, v) for s, v, b, _ in reversed(folded) if s == stream), (agg.state, agg.version))
                for e in events:
                    body, version = agg.apply(copy.deepcopy(body), e.typ, e.body), version + 1
                folded.append((stream, version, body, snapshot))
            snaps = [*self._snapshots, *[(s, v, b) for s, v, b, snapshot in folded if snapshot]]
            if snaps:
                own = self.store.row_tenant(self.context.tenant)
                out.add["snapshots"] = self.store.part([(own, s, v, json.dumps(b), now()) for s, v, b in snaps], "snapshots", "stream_id")
            moved[:] = [(agg, v, b) for (_, agg, _, _), (_, v, b, _) in zip(self._aggregates, folded)]
            saved.clear()
            saved.update(saved_now)
            return out if out.add or out.set else None

        self.store.commit(change, self.context.tenant)
        self._known |= saved
        for agg, version, body in moved:
            agg.hydrate(body, version)
        self.clear()


class SessionAggregates:
    """Loads and commits aggregates within a session: nothing is written before
    save_changes(), and then all of it or none."""

    def __init__(self, session: DocumentSession, validator: Callable[[Any], str | None] | None = None):
        self.session, self.validator = session, validator

    def _events(self):
        found = self.session.store.events()
        return found.for_tenant(self.session.context.tenant) if self.session.context.tenant else found

    def load(self, stream_id: str, kind: type) -> Any:
        """From the last snapshot on."""
        from .aggregates import AggregateRepository

        return AggregateRepository(self._events()).load_with_snapshot(stream_id, kind)

    def commit(self, stream_id: str, agg: Any, events: list, snapshot: bool = False) -> None:
        """Stages events after the validator saw the present state."""
        if self.validator is not None and (wrong := self.validator(agg.state)):
            raise ValidationFailed(wrong)
        self.session.enqueue_aggregate(stream_id, agg, events, snapshot)
