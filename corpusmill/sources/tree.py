"""A data source over trees of files: folders are the partitions, pruned folders are never entered, dot files are kept.

Spark's own file sources leave out names that begin with a dot or an underscore, and read what a filter drops afterwards. Here the driver
lists folders from the top until there are enough for the tasks; each task walks what is below its folders, and opens the files
that the patterns let through."""

from __future__ import annotations

import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders that no scan enters.
PRUNED = (".git", ".gradle", "build", "target", "node_modules")
BATCH = 16 << 20  # bytes of content that a batch of rows holds; a larger file is a batch of its own


def glob_pattern(glob: str) -> str:
    """A regular expression over relative paths; ** crosses folders, a glob without a slash also matches base names."""
    out = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob))
    return f"^{out}$" if "/" in glob else f"(^|/){out}$"


class Folder(InputPartition):
    """A folder below the root: with all that is in it, or with its own files only."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.include = [glob_pattern(g) for g in options.get("include", "**").split("\n")]
        self.exclude = [glob_pattern(g) for g in options.get("exclude", "").split("\n") if g]
        self.depth, self.folders = int(options.get("maxdepth", "64")), int(options.get("folders", "64"))

    def _open(self):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.root)
        return files, root.rstrip("/")

    def _entries(self, files, root: str, path: str):
        """Folders to enter and files to read of a folder, by their paths below the root; repo/a/b is two deep."""
        from pyarrow import fs

        folders, found = [], []
        for info in sorted(files.get_file_info(fs.FileSelector(f"{root}/{path}".rstrip("/"))), key=lambda i: i.path):
            rel = f"{path}/{info.base_name}".lstrip("/")
            if info.type == fs.FileType.Directory:
                if "/" not in rel or (info.base_name not in PRUNED and rel.count("/") < self.depth):
                    folders.append(rel)
            elif "/" in rel:
                inner = rel.split("/", 1)[1]
                if any(re.search(p, inner) for p in self.include) and not any(re.search(p, inner) for p in self.exclude):
                    found.append((rel, info.size))
        return folders, found

    def partitions(self):
        files, root = self._open()
        done, todo = [], [""]
        while todo and len(done) + len(todo) < self.folders:
            below = []
            for path in todo:
                done.append(Folder(path, False))
                below += self._entries(files, root, path)[0]
            todo = below
        return done + [Folder(p, True) for p in todo]

    def read(self, partition: Folder):
        import pyarrow as pa

        files, root = self._open()
        rows, held, todo = [], 0, [partition.path]

        def batch():
            repo, path, content, size = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(repo), pa.array(path), pa.array(content, pa.binary()), pa.array(size, pa.int64())], ["repo", "path", "content", "size"])

        while todo:
            folders, found = self._entries(files, root, todo.pop())
            if partition.deep:
                todo += folders
            for rel, size in found:
                if rows and held + size > BATCH:
                    yield batch()
                    rows, held = [], 0
                with files.open_input_stream(f"{root}/{rel}") as stream:
                    content = stream.read()
                rows.append((*rel.split("/", 1), content, len(content)))
                held += len(content)
        if rows:
            yield batch()


class TreeSource(DataSource):
    """repo (first folder), path (below it), content, size of the files of a tree; options include, exclude (globs, one a line), maxDepth, folders."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "repo string, path string, content binary, size long"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})
