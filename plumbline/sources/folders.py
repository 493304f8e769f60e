"""A data source that lists folders in tasks, and one that writes a prepared tree and shows it only when all of it is there.

``file:`` paths are read as they are; any other scheme is one that Arrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

LISTING = "path string, length long, is_dir boolean"
WRITTEN = "source_image string, source_split string, label_path string, output_image string, sha256 string, parent_id string, output_split string, group_id string"
MANIFEST = ("source_image", "source_split", "output_image", "sha256", "parent_id", "output_split", "group_id")  # fixed values: keys of a manifest's row
BATCH = 10_000
BLOCK = 1 << 20


def opened(path: str):
    """The Arrow file system of a path, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return (LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else FileSystem.from_uri(path)


@dataclass
class Folders(InputPartition):
    paths: list[str]


class _Lister(DataSourceReader):
    def __init__(self, folders: list[str], tasks: int):
        self.folders, self.tasks = folders, tasks

    def partitions(self) -> list[InputPartition]:
        return [Folders(self.folders[i :: self.tasks]) for i in range(min(self.tasks, len(self.folders)))]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileType

        for folder in partition.paths:
            fs, at = opened(folder)
            found = fs.get_file_info(FileSelector(at))
            for k in range(0, len(found), BATCH):
                part = found[k : k + BATCH]
                columns = [[f"{folder}/{f.base_name}" for f in part], [f.size or 0 for f in part], [f.type == FileType.Directory for f in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["path", "length", "is_dir"])


class FolderListing(DataSource):
    """Files and folders right below the folders that the option ``folders`` names as a JSON list, which are dealt out among ``tasks`` partitions."""

    @classmethod
    def name(cls) -> str:
        return "plumbline_folders"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Lister(json.loads(self.options["folders"]), int(self.options["tasks"]))


def list_folders(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, length, is_dir) of what is right below the folders."""
    spark.dataSource.register(FolderListing)
    tasks = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format(FolderListing.name()).option("folders", json.dumps(folders)).option("tasks", str(tasks)).load()


@dataclass
class Copied(WriterCommitMessage):
    part: int
    rows: int
    manifest: str


class _TreeWriter(DataSourceArrowWriter):
    """Tasks copy into a folder beside the output; committing moves that folder to its place, with the manifest and the class list in it."""

    def __init__(self, root: str, report: dict, class_list: str):
        self.root, self.report, self.class_list = root.rstrip("/"), report, class_list
        self.staging = f"{self.root}.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        manifest = f"{self.staging}/manifest/{part}-{uuid.uuid4().hex}"  # an attempt's own; only that of the attempt that counts is used
        fs, at = opened(manifest)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(at) as listed:
            for batch in iterator:
                for row in batch.to_pylist():
                    target = row["output_image"]
                    folder, _, name = target.rpartition("/")
                    label = f"{folder.rpartition('/')[0]}/labels/{name.rpartition('.')[0]}.txt"
                    copy(row["source_image"], f"{self.staging}/tree/{target}")
                    copy(row["label_path"], f"{self.staging}/tree/{label}")
                    row["output_image"] = f"{self.root}/{target}"
                    listed.write((json.dumps({k: row[k] for k in MANIFEST}, ensure_ascii=False) + "\n").encode("utf-8"))
                    n += 1
        return Copied(part, n, manifest)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.part)
        fs, tree = opened(f"{self.staging}/tree")
        fs.create_dir(tree, recursive=True)
        with fs.open_output_stream(f"{tree}/data.yaml") as out:
            out.write(self.class_list.encode("utf-8"))
        with fs.open_output_stream(f"{tree}/split_manifest.json") as out:
            head = json.dumps(self.report, indent=2, ensure_ascii=False)
            out.write((head[: head.rindex("}")].rstrip() + ',\n  "manifest": [').encode("utf-8"))
            first = True
            for m in parts:  # one part after the other, line by line
                with fs.open_input_stream(opened(m.manifest)[1]) as rows:
                    for line in lines(rows):
                        out.write((b"\n    " if first else b",\n    ") + line)
                        first = False
            out.write(b"\n  ]\n}" if not first else b"]\n}")
        place = opened(self.root)[1]
        for found in fs.get_file_info([place]):
            if found.type.name == "Directory":
                fs.delete_dir(place)  # it was empty when the run began
        fs.move(tree, place)
        self.clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear()

    def clear(self) -> None:
        fs, at = opened(self.staging)
        if fs.get_file_info(at).type.name == "Directory":
            fs.delete_dir(at)


class PreparedTree(DataSource):
    """Writes rows of ``WRITTEN`` as a tree below the option ``root``: images, labels, ``data.yaml`` and one ``split_manifest.json`` with the JSON ``report`` and all rows."""

    @classmethod
    def name(cls) -> str:
        return "plumbline_tree"

    def schema(self) -> str:
        return WRITTEN

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _TreeWriter(self.options["root"], json.loads(self.options["report"]), self.options["class_list"])


def write_tree(rows: DataFrame, root: str, report: dict, class_list: str) -> None:
    """Copy the images and labels of ``rows`` below ``root``. Rows come into the manifest in their order.

    Until all tasks have ended the output isn't there: they write beside it. A run that fails removes that; one that is killed leaves it beside an output
    that is still missing or empty. A task that runs again writes the same bytes to the same names.
    """
    spark = rows.sparkSession
    spark.dataSource.register(PreparedTree)
    names = [c.split()[0] for c in WRITTEN.split(", ")]
    rows.select(*names).write.format(PreparedTree.name()).mode("append").options(root=root, report=json.dumps(report, ensure_ascii=False), class_list=class_list).save()


def copy(source: str, target: str) -> None:
    """One file, block by block; missing folders are made."""
    fs, at = opened(source)
    to_fs, to = opened(target)
    to_fs.create_dir(to.rpartition("/")[0], recursive=True)
    with fs.open_input_stream(at) as read, to_fs.open_output_stream(to) as write:
        while block := read.read(BLOCK):
            write.write(block)


def lines(stream) -> Iterator[bytes]:
    """Lines of a binary stream without their ends."""
    rest = b""
    while block := stream.read(BLOCK):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest
