"""Question sets and checkpoint folders as data sources: spark.read.format("tessera_tasks") and others.

A question set is a folder of JSON-lines files in one of three published shapes. Each file, or each stretch of a large
one, is a partition; filters on task_id and n_hops are applied while lines are read, before passages are put together.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, SimpleDataSourceStreamReader

#: Bytes of a file that one partition reads.
STRETCH = 64 << 20
TASKS = "task_id string, question string, gold_answer string, gold_aliases array<string>, supporting_titles array<string>, passages array<struct<title:string,text:string>>, dataset string, hops string, n_hops int"


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def _distinct(values) -> list[str]:
    return list(dict.fromkeys(str(v) for v in values))


def _row(task_id, raw: dict, dataset: str, aliases: list, titles: list, passages: list, hops, n_hops) -> tuple:
    return task_id, raw.get("question"), raw.get("answer"), aliases, titles, passages, dataset, hops, n_hops


def paired_lists(raw: dict, task_id: str, dataset: str) -> tuple:
    """context {title: [...], sentences: [[...]]} and supporting_facts {title: [...]}; titles may be numbers."""
    context, facts = raw.get("context") or {}, raw.get("supporting_facts") or {}
    passages = [(str(t), " ".join(map(str, s))) for t, s in zip(context.get("title") or [], context.get("sentences") or [])]
    return _row(task_id, raw, dataset, [], _distinct(facts.get("title") or []), passages, None, None)


def pair_context(raw: dict, task_id: str, dataset: str) -> tuple:
    """context [[title, [sentence, ...]], ...] and supporting_facts [[title, number], ...]."""
    passages = [(str(t), " ".join(map(str, s))) for t, s in raw.get("context") or []]
    return _row(task_id, raw, dataset, [], _distinct(f[0] for f in raw.get("supporting_facts") or []), passages, None, None)


def hop_paragraphs(raw: dict, task_id: str, dataset: str) -> tuple:
    """paragraphs [{title, paragraph_text, is_supporting}]: a title's k-th repeat is 'title (k)', wherever it stands.

    hops is what the id has before its first double underscore, n_hops its first digit, 0 without one.
    """
    seen: dict[str, int] = {}
    passages, titles = [], []
    for p in raw.get("paragraphs") or []:
        title = str(p.get("title", "")).strip()
        seen[title] = seen.get(title, 0) + 1
        title = title if seen[title] == 1 else f"{title} ({seen[title]})"
        passages.append((title, p.get("paragraph_text")))
        if p.get("is_supporting"):
            titles.append(title)
    hops = str(raw.get("id", "")).split("__")[0]
    aliases = [a for a in raw.get("answer_aliases") or [] if a != raw.get("answer")]
    return _row(task_id, raw, dataset, aliases, titles, passages, hops, int(hops[0]) if hops[:1].isdigit() else 0)


SHAPES = {"paired_lists": paired_lists, "pair_context": pair_context, "hop_paragraphs": hop_paragraphs}


class Stretch(InputPartition):
    def __init__(self, file: str, begin: int, end: int) -> None:
        self.file, self.begin, self.end = file, begin, end


def lines(file: str, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines that begin in a stretch of a file."""
    system, path = _system(file)
    with system.open_input_file(path) as raw:
        f = io.BufferedReader(raw, 1 << 20)
        at = begin
        if begin:  # the line that reaches over the border belongs to the stretch before
            f.seek(begin - 1)
            at = begin - 1 + len(f.readline())
        f.seek(at)
        while at < end and (line := f.readline()):
            yield at, line
            at += len(line)


class TaskReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.shape, self.dataset = options["path"], options["shape"], options.get("dataset", options["shape"])
        self.stretch = int(options.get("stretch", STRETCH))
        self.ids: set[str] | None = None
        self.least_hops: int | None = None
        if self.shape not in SHAPES:
            raise ValueError(f"shape must be one of {', '.join(SHAPES)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("task_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = values if self.ids is None else self.ids & values
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("n_hops",):
                self.least_hops = max(f.value, self.least_hops or f.value)
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        from pyarrow import fs

        system, path = _system(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else sorted((i for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and i.base_name.endswith((".json", ".jsonl", ".txt")) and i.base_name[0] not in "._"), key=lambda i: i.path)
        prefix = self.path[: self.path.index(path)] if path in self.path else "file://"
        return [Stretch(f"{prefix}{i.path}", at, min(i.size, at + self.stretch)) for i in files for at in range(0, i.size, self.stretch)] or [Stretch(self.path, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        make, held = SHAPES[self.shape], []
        for at, line in lines(partition.file, partition.begin, partition.end) if partition.end else ():
            if not line.strip():
                continue
            raw = json.loads(line)
            task_id = str(raw["id"]) if self.shape == "hop_paragraphs" else f"{self.dataset}-{raw['id'] if 'id' in raw else f'{partition.file}:{at}'}"
            if self.ids is not None and task_id not in self.ids:
                continue
            row = make(raw, task_id, self.dataset)
            if self.least_hops is None or (row[-1] is not None and row[-1] >= self.least_hops):
                held.append(row)
            if len(held) >= 500:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text, texts = pa.string(), pa.list_(pa.string())
    kinds = [text, text, text, texts, texts, pa.list_(pa.struct([("title", text), ("text", text)])), text, text, pa.int32()]
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[5] = [[{"title": t, "text": x} for t, x in of] for of in columns[5]]
    names = [f.split()[0] for f in TASKS.replace("struct<title:string,text:string>", "x").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class Tasks(DataSource):
    """Options: path (file or folder), shape (paired_lists, pair_context, hop_paragraphs), dataset, stretch."""

    @classmethod
    def name(cls) -> str:
        return "tessera_tasks"

    def schema(self) -> str:
        return TASKS

    def reader(self, schema) -> TaskReader:
        return TaskReader(dict(self.options))


def steps_in(path: str) -> list[int]:
    """Steps of path's global_step_<n>/actor checkpoints, ascending; a folder that isn't there has none."""
    import re

    from pyarrow import fs

    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    at = {int(m[1]): i.path for i in found if i.type == fs.FileType.Directory and (m := re.fullmatch(r"global_step_(\d+)", i.base_name))}
    whole = system.get_file_info([f"{p}/actor" for p in at.values()])
    return sorted(s for s, i in zip(at, whole, strict=True) if i.type == fs.FileType.Directory)


class CheckpointReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(None)]

    def read(self, partition) -> Iterator[tuple[int]]:
        return iter([(s,) for s in steps_in(self.path)])


class CheckpointStream(SimpleDataSourceStreamReader):
    """Steps above all that came before: a trainer's steps rise, so the greatest one is the offset."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"step": -1}

    def read(self, start: dict) -> tuple[Iterator[tuple[int]], dict]:
        new = [s for s in steps_in(self.path) if s > start["step"]]
        return iter([(s,) for s in new]), {"step": max(new, default=start["step"])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int]]:
        return iter([(s,) for s in steps_in(self.path) if start["step"] < s <= end["step"]])

    def commit(self, end: dict) -> None:
        pass


class Checkpoints(DataSource):
    """Steps of a trainer's checkpoint folder (option path), as a table or a stream: step."""

    @classmethod
    def name(cls) -> str:
        return "tessera_checkpoints"

    def schema(self) -> str:
        return "step long"

    def reader(self, schema) -> CheckpointReader:
        return CheckpointReader(self.options["path"])

    def simpleStreamReader(self, schema) -> CheckpointStream:
        return CheckpointStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tasks)
    spark.dataSource.register(Checkpoints)
