"""Raw records to canonical events: one schema whatever the source."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions import fields as A
from tracewell.functions.masks import integer
from tracewell.functions.net import address, host_ips
from tracewell.functions.text import basename, canonical_host, canonical_user, guid, present, sha256_from, task_command
from tracewell.functions.times import parse_time

REF = "struct<guid:string,pid:bigint,name:string,path:string,cmd:string,user:string,sha256:string>"
# Event codes by source family.
SYSMON = {
    "1": "process_start", "5": "process_end", "3": "network", "7": "image_load", "8": "inject", "10": "process_access", "11": "file_create", "15": "file_create", "29": "file_create", "23": "file_delete",
    "26": "file_delete", "2": "file_time", "13": "registry_set", "17": "pipe_create", "18": "pipe_connect", "22": "dns", "25": "tamper",
}
SECURITY = {"4688": "process_start", "4689": "process_end", "4697": "service_install", "4698": "task_create", "4624": "logon", "4625": "logon_failed"}
SYSTEM = {"7045": "service_install"}
INJECTION_APIS = r"(?i)^(WriteProcessMemory|CreateRemoteThread\w*|NtCreateThreadEx|QueueUserAPC\w*|NtQueueApcThread\w*|SetThreadContext|Wow64SetThreadContext|NtSetContextThread|NtMapViewOfSection|MapViewOfFile\w*|VirtualAllocEx|NtWriteVirtualMemory)$"
RAN_CODE = ("hollow_image", "shellcode", "allocate_shellcode", "execute_shellcode")
EVENT_COLUMNS = (
    "id", "line_id", "file", "line", "t", "host", "kind", "source", "proc", "parent", "target", "file_path", "file_sha256", "access", "api", "behaviors", "target_suspended", "tampering", "real_parent",
    "effective_parent", "net", "dns_answer", "reg", "pipe", "launches", "account", "src", "host_ips", "logon_type", "http",
)


def _code_kind(code: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, kind in table.items():
        out = F.when(code == k, kind).otherwise(out)
    return out


def source_family(origin: Column) -> Column:
    """sysmon, security, system, edr or ''."""
    system = origin.rlike(r"(^|[ .:])system( |$)|service control manager|system\.system")
    return F.when(origin.contains("sysmon"), "sysmon").when(origin.contains("security"), "security").when(system, "system").when(origin.contains("endpoint"), "edr").otherwise("")


def _has(c: Column, word: str) -> Column:
    """a category or type is the word or a list with it."""
    return F.coalesce(F.lower(c).rlike(rf"(^|[ ,]){word}($|[ ,])"), F.lit(False))


def ecs_kind() -> Column:
    """the kind from categories, types and actions, the first rule that holds."""
    category, kind = F.col("f_category"), F.col("f_type")
    action, outcome = F.lower(F.coalesce("f_action", F.lit(""))), F.lower(F.coalesce("f_outcome", F.lit("")))
    process, file = _has(category, "process"), _has(category, "file")
    auth, change = _has(category, "authentication"), _has(kind, "change") | _has(kind, "creation")
    return (
        F.when(F.lower("f_kind") == "execution", "process_start")
        .when((_has(category, "api") & F.coalesce(F.col("f_api_name").rlike(INJECTION_APIS), F.lit(False))) | action.contains("inject"), "inject")
        .when(process & (_has(kind, "start") | action.rlike("^(start|exec|fork|create|process_started|created-process|process creation)$")), "process_start")
        .when(process & (_has(kind, "end") | action.rlike("^(end|exit|exited-process|process_stopped)$")), "process_end")
        .when(_has(category, "library") | _has(category, "driver"), "image_load")
        .when(file & change, "file_create").when(file & _has(kind, "deletion"), "file_delete")
        .when(auth & (outcome == "failure"), "logon_failed").when(auth & ((outcome == "success") | _has(kind, "start")), "logon")
        .when(_has(category, "web"), "http_request")
        .when(_has(category, "network") & F.col("f_query").isNotNull(), "dns").when(_has(category, "network"), "network")
        .when(_has(category, "registry") & change, "registry_set")
        .otherwise("other")
    )


def _ref(**parts: Column) -> Column:
    """A process reference; null if nothing is known."""
    names = ("guid", "pid", "name", "path", "cmd", "user", "sha256")
    made = F.struct(*[(parts[n] if n in parts else F.lit(None)).cast("long" if n == "pid" else "string").alias(n) for n in names])
    return F.when(F.coalesce(*[parts[n].cast("string") for n in names if n in parts]).isNotNull(), made)


def _image(path: str, name: str) -> tuple[Column, Column]:
    p = present(F.trim(F.col(path)))
    return p, F.coalesce(present(F.trim(F.col(name))), basename(p))


def classify(records: DataFrame) -> DataFrame:
    """Raw records with the canonical fields f_*, ``family``, ``unknown`` (F2), ``kind`` and ``source``."""
    nested = records.where("nested is not null").withColumn("parsed", A.parse_nested(F.col("nested"))).withColumn("parts", A.parse_parts(F.col("parsed")))
    base = ["file", "line", "id", "line_id", "nested", "flat", "names"]
    rows = A.nested_fields(nested.withColumn("is_flat", F.lit(False)), [*base, "is_flat"], F.col("parsed"), F.col("parts"))
    rows = rows.unionByName(records.where("nested is null").select(*base, F.lit(True).alias("is_flat"), *A.flat_fields(F.col("flat"))))
    code = F.trim("f_code")
    rows = rows.withColumn("family", source_family(F.col("f_origin"))).withColumn("code", code)
    known = (F.col("family") != "") | F.coalesce(F.col("code") == "4688", F.lit(False)) | F.coalesce("f_category", "f_kind", "f_windows_log").isNotNull()
    by_code = F.when(F.col("family") == "sysmon", _code_kind(F.col("code"), SYSMON)).when(F.col("family") == "security", _code_kind(F.col("code"), SECURITY)).when(F.col("family") == "system", _code_kind(F.col("code"), SYSTEM)).when((F.col("family") == "") & (F.col("code") == "4688"), "process_start")
    kind = F.when(by_code.isNotNull(), by_code).when(F.col("family").isin("sysmon", "security"), "other").otherwise(ecs_kind())
    source = F.when((F.col("family") != "") & F.col("code").isNotNull(), F.concat_ws(":", "family", "code")).when(F.col("family") != "", F.col("family")).when(F.col("is_flat"), "flat").otherwise("ecs")
    return rows.withColumn("unknown", ~known).withColumn("kind", F.when(known, kind)).withColumn("source", F.when(known, source))


def to_events(classified: DataFrame) -> DataFrame:
    """Canonical events of the records that a built-in rule understands (F5, F6: the others are left out)."""
    kind, is_4688 = F.col("kind"), F.col("source") == "security:4688"
    of = lambda *kinds: kind.isin(*kinds)
    pid, new_pid = integer(F.col("f_pid")), integer(F.col("f_new_pid"))
    path, name = _image("f_path", "f_name")
    started = of("process_start")
    proc = _ref(guid=guid(F.col("f_guid")), pid=F.when(is_4688, F.coalesce(new_pid, pid)).otherwise(F.coalesce(pid, new_pid)), path=path, name=name, user=canonical_user(F.col("f_user")), cmd=F.when(started, present(F.trim("f_cmd"))), sha256=F.when(started, F.coalesce(F.lower("f_sha256"), sha256_from(F.col("f_hashes")))))
    p_path, p_name = _image("f_parent_path", "f_parent_name")
    p_pid = F.coalesce(integer(F.col("f_parent_pid")), F.when(is_4688 & F.col("f_new_pid").isNotNull(), pid))
    parent = _ref(guid=guid(F.col("f_parent_guid")), pid=p_pid, path=p_path, name=p_name, cmd=present(F.trim("f_parent_cmd")))
    t_path, t_name = _image("f_target_path", "f_target_name")
    target = _ref(guid=guid(F.col("f_target_guid")), pid=integer(F.col("f_target_pid")), path=t_path, name=t_name)
    real = integer(F.col("f_real_parent_pid"))
    e_guid, e_pid = guid(F.col("f_effective_guid")), integer(F.col("f_effective_pid"))
    e_pid = F.when(e_pid > 0, e_pid)
    e_path, e_name = _image("f_effective_path", "f_effective_name")
    same = F.when(e_guid.isNotNull() & guid(F.col("f_parent_guid")).isNotNull(), e_guid == guid(F.col("f_parent_guid"))).otherwise(e_pid.eqNullSafe(p_pid))
    effective = F.when(F.coalesce(e_guid, e_pid.cast("string")).isNotNull() & ~same, _ref(guid=e_guid, pid=e_pid, path=e_path, name=e_name))
    text = lambda c: present(F.trim(F.col(c)))
    flagged = lambda *cols: F.coalesce(*[c.cast("string") for c in cols]).isNotNull()
    ran = F.filter(F.transform("f_behaviors", F.lower), lambda b: b.isin(*RAN_CODE))
    files, net = of("file_create", "file_delete", "file_time", "image_load"), of("network", "dns")
    away = of("logon", "logon_failed", "http_request", "network")
    ip, port, domain = F.col("f_ip"), integer(F.col("f_port")), F.when(of("dns"), F.col("f_query")).otherwise(F.col("f_domain"))
    s_ip, s_port, s_host = address(F.col("f_src_ip")), integer(F.col("f_src_port")), text("f_src_host")
    ips = host_ips(F.col("f_host_ip"))
    status = integer(F.col("f_status"))
    rows = classified.where("not unknown and kind <> 'other'").select(
        "id", "line_id", "file", "line", F.when(F.col("is_flat"), parse_time(F.col("f_time"), False)).otherwise(parse_time(F.col("f_time"), True)).alias("t"), canonical_host(F.col("f_host")).alias("host"), "kind", "source",
        proc.cast(REF).alias("proc"), F.when(started, parent).cast(REF).alias("parent"), F.when(of("inject", "process_access"), target).cast(REF).alias("target"),
        F.when(files, text("f_file_path")).alias("file_path"), F.when(files, F.coalesce(F.lower("f_file_sha256"), sha256_from(F.col("f_hashes")))).alias("file_sha256"),
        F.when(of("inject", "process_access"), integer(F.col("f_access"))).alias("access"), F.when(of("inject"), text("f_api_name")).alias("api"),
        F.when(of("inject") & (F.size(ran) > 0), ran).alias("behaviors"), F.when(of("inject") & (F.lower("f_target_suspended") == "true"), True).alias("target_suspended"),
        F.when(of("tamper"), text("f_tampering")).alias("tampering"),
        F.when(started & (real > 0) & ~real.eqNullSafe(p_pid), _ref(pid=real)).cast(REF).alias("real_parent"), F.when(started, effective).cast(REF).alias("effective_parent"),
        F.when(net & flagged(ip, port, domain), F.struct(ip.alias("ip"), port.alias("port"), domain.alias("domain"))).alias("net"),
        F.when(of("dns") & (F.lower("f_action") == "lookup_result"), True).alias("dns_answer"),
        F.when(of("registry_set"), F.struct(F.col("f_reg_key").alias("key"), F.col("f_reg_value").alias("value"))).alias("reg"),
        F.when(of("pipe_create", "pipe_connect"), F.col("f_pipe")).alias("pipe"),
        F.when(of("service_install"), text("f_service")).when(of("task_create"), task_command(F.col("f_task_content"))).alias("launches"),
        F.when(away & ~of("network"), canonical_user(F.col("f_account"))).alias("account"),
        F.when(away & flagged(s_ip, s_port, s_host), F.struct(s_ip.alias("ip"), s_port.alias("port"), s_host.alias("host"))).alias("src"),
        F.when(away & (F.size(ips) > 0), ips).alias("host_ips"), F.when(of("logon", "logon_failed"), F.col("f_logon_type")).alias("logon_type"),
        F.when(of("http_request") & flagged(F.col("f_method"), F.col("f_url"), status), F.struct(F.col("f_method").alias("method"), F.col("f_url").alias("url"), status.alias("status"))).alias("http"),
    )
    named = F.coalesce("proc.guid", F.col("proc.pid").cast("string"), "proc.name", "proc.path", "proc.cmd", "proc.sha256").isNotNull()
    return rows.where((F.col("kind") != "process_start") | named)


def read_statistics(read: dict, made: dict, classified: DataFrame) -> dict:
    """A5: records, unknown, kept, untimed, other, by_source and by_input (counts by name and by input).

    ``read`` and ``made`` were observed while the records and their events were written; only the counts by source, which
    are as many as there are sources, take a look at a column of what was written.
    """
    rows = classified.groupBy("file", "source", "unknown").count().collect()
    by_source, by_input = Counter(), Counter()
    for r in rows:
        by_input[r["file"]] += r["count"]
        if not r["unknown"]:
            by_source[r["source"]] += r["count"]
    return {"records": read["records"], "unknown": read["unknown"], "kept": made["kept"], "untimed": made["untimed"], "by_source": dict(sorted(by_source.items())), "by_input": dict(by_input), "other": read["records"] - read["unknown"] - made["kept"]}
