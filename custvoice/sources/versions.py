"""What a stage was made from, and a log of versions in which the last one counts.

Input files are listed by Spark and stay a table; of them the driver sees one row, a
fingerprint.  A version is a small JSON file, numbered, that names the folders of its
data.  It is put under its number by one rename that never replaces a file, after all
its data has been written: whoever reads sees the version before or the whole of the
new one, and of two writers that began with the same version one is refused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvoice import schema
from custvoice.config import VoiceConfig
from custvoice.sources.tables import file_system, path_exists, read_text, remove, rename_new, write_text

# To be raised when the code gives other results for the same input.
CODE_VERSION = 1

FILE = "path string, length bigint, modified timestamp"


class ConflictingVersion(RuntimeError):
    """Another job has published a version in the meantime."""


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """The files a scan of ``path`` reads: path, length and time of change; contents stay unread."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no such input: {path}")
    listed = spark.read.format("binaryFile").load(path)
    return listed.select("path", "length", F.col("modificationTime").alias("modified"))


def files_fingerprint(files: DataFrame) -> str:
    """A digest of a list of files, whatever its order."""
    mark = F.xxhash64("path", "length", "modified")
    row = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(mark), F.sum(F.shiftright(mark, 20))).first()
    return _digest([str(x) for x in row])


def settings_fingerprint(config: VoiceConfig, limit: int | None, classifier: str, **more: object) -> str:
    """A digest of everything but the input that decides a stage's rows.

    ``classifier`` names the classifier and its version; nothing else can tell that it changed.
    """
    return _digest([CODE_VERSION, schema.ENRICHED.json(), asdict(config), limit, classifier, more])


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


# What is stored of a segment, each in a folder of its own below one for all segments.
STAGES = ("prepared", "enriched", "cube")


@dataclass(frozen=True)
class Segment:
    """The rows of some input files, as one run wrote them: ``rows`` from position ``first``, ``kept`` of them flagged."""

    name: str
    first: int
    rows: int
    kept: int


@dataclass(frozen=True)
class Version:
    number: int
    settings: str
    manifest: str  # table of the files read, with the segment each went into
    segments: tuple[Segment, ...] = field(default=())

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)

    @property
    def kept(self) -> int:
        return sum(s.kept for s in self.segments)


class Publications:
    """Numbered JSON files in a folder; each is there as a whole or not at all, and the last counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, number: int) -> str:
        return f"{self.folder}/{number:08d}.json"

    def last(self) -> int | None:
        if not path_exists(self.spark, self.folder):
            return None
        files, folder = file_system(self.spark, self.folder)
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=None)

    def read(self, number: int) -> dict:
        return json.loads(read_text(self.spark, self.path(number)))

    def publish(self, number: int, told: dict) -> None:
        """Put ``told`` under its number, unless that is taken."""
        draft, target = f"{self.folder}/.draft-{uuid.uuid4().hex}", self.path(number)
        write_text(self.spark, draft, json.dumps(told))
        try:
            rename_new(self.spark, draft, target)
        except Exception as error:
            remove(self.spark, draft)
            if path_exists(self.spark, target):
                raise ConflictingVersion(f"version {number} exists in {self.folder}") from error
            raise


class VersionLog:
    """The versions under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.numbers = Publications(spark, f"{self.root}/versions")

    def fresh_manifest(self) -> str:
        return f"{self.root}/manifests/{uuid.uuid4().hex}"

    def folder(self, stage: str, segment: str) -> str:
        return f"{self.root}/{stage}/segment={segment}"

    def stage(self, stage: str, version: Version) -> DataFrame:
        """A stage of all segments of a version, which must have one at least."""
        paths = [self.folder(stage, s.name) for s in version.segments]
        # Files that came later may have columns of their own.
        found = self.spark.read.options(mergeSchema=True, basePath=f"{self.root}/{stage}").parquet(*paths)
        return found.drop("segment")

    def last(self) -> Version | None:
        """The version that counts; None before the first."""
        number = self.numbers.last()
        return None if number is None else self.read(number)

    def read(self, number: int) -> Version:
        made = self.numbers.read(number)
        return Version(**made | {"segments": tuple(Segment(**s) for s in made["segments"])})

    def publish(self, version: Version) -> Version:
        """Make ``version`` the one that counts, unless its number is taken."""
        self.numbers.publish(version.number, asdict(version))
        return version

    def clean(self) -> list[str]:
        """Delete folders and versions that the last version does not name: superseded ones, and what stopped jobs left.

        Not to be called while another job writes under this folder.
        """
        last = self.last()
        used = set()
        if last:
            used = {self.folder(stage, s.name) for stage in STAGES for s in last.segments}
            used |= {last.manifest, self.numbers.path(last.number)}
        gone = []
        for kind in (*STAGES, "manifests", "versions"):
            if not path_exists(self.spark, f"{self.root}/{kind}"):
                continue
            files, folder = file_system(self.spark, f"{self.root}/{kind}")
            for status in files.listStatus(folder):
                mine = f"{self.root}/{kind}/{status.getPath().getName()}"
                if mine not in used:
                    files.delete(status.getPath(), True)
                    gone.append(mine)
        return gone
