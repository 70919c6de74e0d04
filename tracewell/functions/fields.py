"""Where each canonical field lives in a source, and how it is read from nested or flat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracewell.functions.text import present

# Names of canonical fields in sources, in order of preference.
ALIASES: dict[str, tuple[str, ...]] = {
    "time": ("@timestamp", "timestamp", "time", "_time", "UtcTime", "TimeCreated", "SystemTime", "event.created"),
    "host": ("host.name", "host.hostname", "winlog.computer_name", "Computer", "ComputerName", "hostname", "host", "DeviceName"),
    "code": ("event.code", "winlog.event_id", "EventID", "EventCode"),
    "origin": ("winlog.channel", "Channel", "LogName", "event.dataset", "data_stream.dataset", "event.module", "event.provider", "winlog.provider_name", "ProviderName", "Provider", "SourceName", "source", "sourcetype"),
    "kind": ("kind",),
    "windows_log": ("winlog.channel", "winlog.provider_name", "Channel", "LogName", "ProviderName"),
    "category": ("event.category", "category"),
    "type": ("event.type", "type"),
    "action": ("event.action", "action"),
    "guid": ("process.entity_id", "winlog.event_data.ProcessGuid", "ProcessGuid", "winlog.event_data.SourceProcessGUID", "SourceProcessGUID", "SourceProcessGuid"),
    "pid": ("process.pid", "winlog.event_data.ProcessId", "ProcessId", "SourceProcessId", "pid"),
    "new_pid": ("winlog.event_data.NewProcessId", "NewProcessId"),
    "path": ("process.executable", "winlog.event_data.Image", "Image", "NewProcessName", "SourceImage", "process.path"),
    "name": ("process.name",),
    "cmd": ("process.command_line", "winlog.event_data.CommandLine", "CommandLine", "ProcessCommandLine"),
    "user": ("user.name", "winlog.event_data.User", "User", "UserName", "SubjectUserName", "AccountName"),
    "sha256": ("process.hash.sha256", "sha256"),
    "hashes": ("winlog.event_data.Hashes", "Hashes", "winlog.event_data.Hash", "Hash"),
    "parent_guid": ("process.parent.entity_id", "winlog.event_data.ParentProcessGuid", "ParentProcessGuid"),
    "parent_pid": ("process.parent.pid", "winlog.event_data.ParentProcessId", "ParentProcessId", "CreatorProcessId", "ppid"),
    "parent_path": ("process.parent.executable", "winlog.event_data.ParentImage", "ParentImage", "ParentProcessName"),
    "parent_name": ("process.parent.name",),
    "parent_cmd": ("process.parent.command_line", "winlog.event_data.ParentCommandLine", "ParentCommandLine"),
    "target_guid": ("winlog.event_data.TargetProcessGUID", "TargetProcessGUID", "TargetProcessGuid", "Target.process.entity_id"),
    "target_pid": ("winlog.event_data.TargetProcessId", "TargetProcessId", "Target.process.pid"),
    "target_path": ("winlog.event_data.TargetImage", "TargetImage", "Target.process.executable"),
    "target_name": ("Target.process.name",),
    "access": ("winlog.event_data.GrantedAccess", "GrantedAccess"),
    "api_name": ("process.Ext.api.name",),
    "real_parent_pid": ("process.parent.Ext.real.pid",),
    "behaviors": ("process.Ext.api.behaviors",),
    "target_suspended": ("Target.process.Ext.created_suspended",),
    "effective_guid": ("process.Ext.effective_parent.entity_id",),
    "effective_pid": ("process.Ext.effective_parent.pid",),
    "effective_path": ("process.Ext.effective_parent.executable",),
    "effective_name": ("process.Ext.effective_parent.name",),
    "tampering": ("winlog.event_data.Type", "Type"),
    "file_path": ("file.path", "winlog.event_data.TargetFilename", "TargetFilename", "dll.path", "winlog.event_data.ImageLoaded", "ImageLoaded", "file"),
    "file_sha256": ("file.hash.sha256", "dll.hash.sha256"),
    "pipe": ("winlog.event_data.PipeName", "PipeName", "file.name"),
    "ip": ("destination.ip", "winlog.event_data.DestinationIp", "DestinationIp"),
    "port": ("destination.port", "winlog.event_data.DestinationPort", "DestinationPort"),
    "domain": ("destination.domain", "winlog.event_data.DestinationHostname", "DestinationHostname"),
    "query": ("dns.question.name", "winlog.event_data.QueryName", "QueryName"),
    "reg_key": ("registry.path", "winlog.event_data.TargetObject", "TargetObject"),
    "reg_value": ("registry.data.strings", "winlog.event_data.Details", "Details"),
    "service": ("winlog.event_data.ServiceFileName", "ServiceFileName", "winlog.event_data.ImagePath", "ImagePath", "service.executable"),
    "task_content": ("winlog.event_data.TaskContent", "TaskContent"),
    "account": ("winlog.event_data.TargetUserName", "TargetUserName", "user.target.name", "user.name", "UserName", "User", "AccountName"),
    "src_ip": ("source.ip", "winlog.event_data.IpAddress", "IpAddress", "winlog.event_data.SourceIp", "SourceIp", "client.ip"),
    "src_port": ("source.port", "winlog.event_data.IpPort", "IpPort", "winlog.event_data.SourcePort", "SourcePort", "client.port"),
    "src_host": ("source.domain", "winlog.event_data.WorkstationName", "WorkstationName"),
    "logon_type": ("winlog.logon.type", "winlog.event_data.LogonType", "LogonType"),
    "outcome": ("event.outcome",),
    "url": ("url.full", "url.original", "url.path"),
    "method": ("http.request.method",),
    "status": ("http.response.status_code",),
    "host_ip": ("host.ip",),
}
#: Fields read as lists; all others by the first value.
LISTS = ("behaviors", "host_ip")
#: Names that are an object in some sources and a value in others.
_BOTH = ("host", "source", "file")


def _schemas() -> tuple[T.StructType, T.StructType, dict[str, T.StructType]]:
    """For the record, for names that another one differs from by case only, and for the parts of _BOTH."""
    tree: dict = {}
    for dotted in sorted({a for names in ALIASES.values() for a in names}):
        if "." in dotted:
            tree[dotted] = None
        at = tree
        *path, leaf = dotted.split(".")
        for p in path:
            if at.get(p) is None:
                at[p] = {}
            at = at[p]
        at.setdefault(leaf, None)

    def struct(node: dict) -> T.StructType:
        return T.StructType([T.StructField(k, struct(v) if v else T.StringType()) for k, v in sorted(node.items(), key=lambda kv: kv[0])])

    parts = {k: struct(tree[k]) for k in _BOTH}
    main, other, seen = {}, {}, set()
    for k in sorted(tree, key=lambda k: (tree[k] is None, k)):
        (other if k.lower() in seen else main)[k] = None if k in _BOTH else tree[k]
        seen.add(k.lower())
    return struct(main), struct(other), parts


MAIN, OTHER, PARTS = _schemas()


def _value(c: Column) -> Column:
    """The first element of an array, nothing for an object, else the value."""
    first = F.get(F.from_json(c, "array<string>"), F.lit(0))
    return present(F.when(c.startswith("["), F.coalesce(first, c)).when(~c.rlike(r'^\{\s*["}]'), c))


def _values(c: Column) -> Column:
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c != "", F.array(c))


def parse_nested(json: Column) -> Column:
    """A struct of what the aliases can name in a JSON object."""
    other = F.when(json.rlike('"(' + "|".join(f.name.replace(".", r"\.") for f in OTHER.fields) + r')"\s*:'), F.from_json(json, OTHER))
    main = F.from_json(json, MAIN)
    return F.struct(main.alias("main"), other.alias("other"))


def parse_parts(parsed: Column) -> Column:
    return F.struct(*[F.when(parsed["main"][k].startswith("{"), F.from_json(parsed["main"][k], s)).alias(k) for k, s in PARTS.items()])


def _nested(dotted: str, parsed: Column, parts: Column) -> list[Column]:
    """The literal dotted key, then the path."""
    out = []
    if "." in dotted:
        out.append(parsed["main"][dotted])
    head, *rest = dotted.split(".")
    if rest and head in _BOTH:
        at = parts[head]
    elif any(f.name == head for f in OTHER.fields):
        at = parsed["other"][head]
    else:
        at = parsed["main"][head]
    for p in rest:
        at = at[p]
    return [*out, at]


def nested_fields(rows: DataFrame, keep: list[str], parsed: Column, parts: Column) -> DataFrame:
    """``rows`` with the columns ``keep`` and a column f_<name> for each canonical field of nested records; ``f_origins`` joins all values of origin.

    First the value that counts for each field, then what it says: were both one projection, each value's many names would
    be looked up once for every use of it, and the code for that grows beyond what the JVM compiles.
    """
    found, said = [], []
    for name, dotted in ALIASES.items():
        each = [present(c) for d in dotted for c in _nested(d, parsed, parts)]
        if name == "origin":
            own = [F.coalesce(*[present(c) for c in _nested(d, parsed, parts)]) for d in dotted]
            found.append(F.concat_ws(" ", *[F.when(~c.startswith('{"'), c) if d == "source" else c for d, c in zip(dotted, own, strict=True)]).alias("f_origin"))
            said.append(F.lower("f_origin").alias("f_origin"))
        else:
            found.append(F.coalesce(*each).alias(f"f_{name}"))
            said.append((_values if name in LISTS else _value)(F.col(f"f_{name}")).alias(f"f_{name}"))
    return rows.select(*keep, *found).select(*keep, *said)


def flat_fields(flat: Column) -> list[Column]:
    """The same columns from a map of normalised names to values."""
    get = lambda d: present(F.element_at(flat, d.lower().translate(str.maketrans("", "", " _.@-"))))
    out = []
    for name, dotted in ALIASES.items():
        if name in LISTS:
            c = F.coalesce(*[get(d) for d in dotted])
            out.append(F.when(c.isNotNull(), F.array(c)).alias(f"f_{name}"))
        elif name == "origin":
            out.append(F.lower(F.concat_ws(" ", *[get(d) for d in dotted])).alias("f_origin"))
        else:
            out.append(F.coalesce(*[get(d) for d in dotted]).alias(f"f_{name}"))
    return out
