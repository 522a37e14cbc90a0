"""Principals, permissions, configuration and certificates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import COMPARE, boundaries, decode, like, quote_name, rules, ticks_to_time
from ..functions.xml import RECORD_SCHEMA, parse_xml
from ..operators.joins import role_join


def orphaned_users(users: DataFrame, logins: DataFrame, skip=("dbo", "guest", "INFORMATION_SCHEMA", "sys")) -> DataFrame:
    """Users whose security id has no login, with the command that repairs them."""
    fix = F.concat(F.lit("ALTER USER "), quote_name("name"), F.lit(" WITH LOGIN = "), quote_name("name"), F.lit(";"))
    return (users.where(F.col("type").isin("S", "U") & ~F.col("name").isin(*skip) & (F.col("authentication_type") != 0))
            .join(logins.select("sid"), "sid", "left_anti").withColumn("fix_command", fix))


def default_db_check(logins: DataFrame, databases: DataFrame) -> DataFrame:
    known = databases.select(F.col("name").alias("_db"), "state_desc")
    status = rules([(F.col("_db").isNull(), "*** DEFAULT DB DOES NOT EXIST ***"), (F.col("state_desc") != "ONLINE", "*** DEFAULT DB IS OFFLINE ***")], "OK")
    return logins.join(known, F.col("default_database_name") == F.col("_db"), "left").withColumn("status", status).drop("_db")


def role_members(members: DataFrame, principals: DataFrame) -> DataFrame:
    return role_join(members, principals, "principal_id", {"role": "role_principal_id", "member": "member_principal_id"}, ["name"])


def role_member_counts(members: DataFrame, principals: DataFrame) -> DataFrame:
    per = members.groupBy("role_principal_id").agg(F.count(F.lit(1)).alias("members"))
    return principals.join(per, F.col("principal_id") == F.col("role_principal_id"), "left").withColumn("members", F.coalesce("members", F.lit(0))).drop("role_principal_id")


def permissions(grants: DataFrame, principals: DataFrame) -> DataFrame:
    """Explicit permissions with grantee and grantor; internal principals left out."""
    rows = role_join(grants, principals, "principal_id", {"grantee": "grantee_principal_id", "grantor": "grantor_principal_id"}, ["name"])
    return rows.where(~like("grantee_name", "##%"))


def object_permissions(grants: DataFrame, principals: DataFrame, objects: DataFrame) -> DataFrame:
    """Database permissions with the object they are on, named schema.object where there is one."""
    target = objects.select(F.col("object_id").alias("major_id"), F.lit("OBJECT_OR_COLUMN").alias("class_desc"), "schema_name", F.col("name").alias("_object"))
    rows = role_join(grants, principals, "principal_id", {"grantee": "grantee_principal_id"}, ["name"])
    rows = rows.where(~F.col("grantee_name").isin("public", "guest") & ~like("grantee_name", "##%"))
    dot = F.when(F.col("_object").isNotNull(), ".").otherwise("")
    name = F.concat(F.coalesce("schema_name", F.lit("")), dot, F.coalesce("_object", F.lit("")))
    return rows.join(target, ["major_id", "class_desc"], "left").withColumn("object_name", name).drop("_object", "schema_name")


def policy_audit(logins: DataFrame) -> DataFrame:
    """Enabled logins that skip a password rule."""
    no_policy, no_expiry = ~F.col("is_policy_checked"), ~F.col("is_expiration_checked")
    warning = rules([(no_policy & no_expiry, "*** BOTH DISABLED ***"), (no_policy, "* Policy off *"), (no_expiry, "* Expiration off *")])
    return logins.where((no_policy | no_expiry) & ~like("name", "##%") & ~F.col("is_disabled")).withColumn("warning", warning)


def denied_logins(grants: DataFrame, principals: DataFrame) -> DataFrame:
    denied = grants.where("permission_name = 'CONNECT SQL' and state_desc = 'DENY'")
    return role_join(denied, principals, "principal_id", {"login": "grantee_principal_id"}, ["name"]).withColumn("status", F.lit("*** LOGIN DENIED CONNECT SQL ***"))


def guest_access(grants: DataFrame, principals: DataFrame, first_user_db: int = 4) -> DataFrame:
    rows = grants.where("permission_name = 'CONNECT' and state_desc = 'GRANT'").where(F.col("database_id") > first_user_db)
    return role_join(rows, principals, "principal_id", {"grantee": "grantee_principal_id"}, ["name"]).where("grantee_name = 'guest'")


def linked_servers(servers: DataFrame, mappings: DataFrame, principals: DataFrame) -> DataFrame:
    who = principals.select(F.col("principal_id").alias("local_principal_id"), F.col("name").alias("local_login"))
    return servers.where("is_linked").join(mappings, "server_id", "left").join(who, "local_principal_id", "left")


def compare_roles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Roles of the first database next to the same name in the second; null where missing."""
    other = b.select(F.col("name").alias("role_name_2")).distinct()
    return a.where("is_role").join(other, F.col("name") == F.col("role_name_2"), "left").select(F.col("name").alias("role_name"), "role_name_2")


def user_mapping(users: DataFrame, members: DataFrame, logins: DataFrame) -> DataFrame:
    """Login, user and role, matched by security id."""
    roles = users.select(F.col("principal_id").alias("role_principal_id"), F.col("name").alias("role_name"))
    server = logins.select("sid", F.col("name").alias("login_name"))
    return (users.join(members, F.col("principal_id") == F.col("member_principal_id")).join(roles, "role_principal_id").join(server, "sid")
            .select("login_name", F.col("name").alias("user_name"), "role_name"))


# --- ring buffer records ---------------------------------------------------

def login_failures(records: DataFrame, now_ticks, now) -> DataFrame:
    r = records.withColumn("_r", parse_xml("record", RECORD_SCHEMA))
    return r.select(F.col("_r._id").alias("record_id"), ticks_to_time("timestamp", now_ticks, now).alias("notification_time"), F.col("_r.Error.SPID").alias("spid"),
                    F.col("_r.Error.ErrorCode").alias("error_code"), F.col("_r.Error.CallingAPIName").alias("calling_api"), F.col("_r.Error.APIName").alias("api"), F.col("_r._type").alias("type"))


def connectivity(records: DataFrame, now_ticks, now) -> DataFrame:
    """Connection records of real sessions, with why a connection ended."""
    r = records.withColumn("_r", parse_xml("record", RECORD_SCHEMA))
    c = "_r.ConnectivityTraceRecord"
    flags = {"PhysicalConnectionIsKilled": "connection_killed", "DisconnectDueToReadError": "read_error", "NetworkErrorFoundInInputStream": "network_error",
             "ErrorFoundBeforeLogin": "error_before_login", "SessionIsKilled": "session_killed", "NormalDisconnect": "normal_disconnect", "NormalLogout": "normal_logout"}
    buffers = {"TdsInputBufferError": "input_error", "TdsOutputBufferError": "output_error", "TdsInputBufferBytes": "input_bytes"}
    return r.where(F.col(f"{c}.Spid") != 0).select(
        F.col("_r._id").alias("record_id"), ticks_to_time("timestamp", now_ticks, now).alias("time_stamp"), F.col(f"{c}.RecordType").alias("action"), F.col(f"{c}.RecordSource").alias("source"),
        F.col(f"{c}.Spid").alias("spid"), F.col(f"{c}.RemoteHost").alias("remote_host"), F.col(f"{c}.RemotePort").alias("remote_port"), F.col(f"{c}.LocalPort").alias("local_port"),
        *[F.col(f"{c}.TdsBuffersInformation.{k}").alias(v) for k, v in buffers.items()], *[F.col(f"{c}.TdsDisconnectFlags.{k}").alias(v) for k, v in flags.items()])


# --- configuration ---------------------------------------------------------

# Setting, then (comparison, value, advice) in order, then the advice that is left.
# {} stands for the value in use.
CONFIG_RULES = {
    "max server memory (MB)": ([("==", 2147483647, "*** SET TO A SPECIFIC VALUE (leave 10-20% for OS) ***")], "OK - set to {} MB"),
    "min server memory (MB)": ([("==", 0, "* Consider setting to ~50% of max server memory *")], "OK"),
    "max degree of parallelism": ([("==", 0, "*** SET TO # OF CORES (max 8) or workload-appropriate value ***"),
                                   (">", 8, "* Consider <=8 for OLTP workloads *")], "OK"),
    "cost threshold for parallelism": ([("==", 5, "*** DEFAULT (5) is too low — set to 25-50 for OLTP ***")], "OK - set to {}"),
    "optimize for ad hoc workloads": ([("==", 0, "*** ENABLE (1) — prevents plan cache bloat ***")], "OK - enabled"),
    "backup compression default": ([("==", 0, "* Consider enabling (1) — saves I/O and space *")], "OK - enabled"),
    "backup checksum default": ([("==", 0, "* Consider enabling (1) — catches silent corruption *")], "OK - enabled"),
    "remote admin connections": ([("==", 0, "* Consider enabling (1) for remote DAC *")], "OK - enabled"),
    "remote access": ([("==", 1, "* Deprecated — consider disabling (0) *")], "OK - disabled"),
    "xp_cmdshell": ([("==", 1, "*** SECURITY RISK — disable unless required ***")], "OK - disabled"),
    "clr enabled": ([("==", 1, "* Enabled — verify this is intentional *")], "OK - disabled"),
    "Ole Automation Procedures": ([("==", 1, "* Enabled — verify this is intentional *")], "OK - disabled"),
    "cross db ownership chaining": ([("==", 1, "*** SECURITY RISK — disable unless required ***")], "OK - disabled"),
    "scan for startup procs": ([("==", 1, "* Enabled — verify startup procs are legitimate *")], "OK"),
    "fill factor (%)": ([("==", 0, "OK - default (100% fill)")], "Set to {}%"),
    "Database Mail XPs": ([], "Review manually"),
    "default trace enabled": ([], "Review manually"),
    "blocked process threshold (s)": ([], "Review manually"),
    "Agent XPs": ([], "Review manually"),
}


def config_audit(settings: DataFrame, table: dict = CONFIG_RULES, name: str = "name", value: str = "value_in_use") -> DataFrame:
    """Listed settings with advice from a rule table."""
    v = F.col(value)
    fill = lambda t: F.concat_ws("", *[p for part in t.split("{}") for p in (F.lit(part), v.cast("string"))][:-1])
    advice = []
    for setting, (steps, otherwise) in table.items():
        advice.append((F.col(name) == setting, rules([(COMPARE[op](v, F.lit(cut)), fill(t)) for op, cut, t in steps], fill(otherwise))))
    return settings.where(F.col(name).isin(*table)).withColumn("recommendation", rules(advice))


# Column, value that is wrong (None: anything but the text), warning.
SETTING_WARNINGS = [
    ("is_auto_close_on", True, "*** DISABLE AUTO_CLOSE ***"),
    ("is_auto_shrink_on", True, " *** DISABLE AUTO_SHRINK ***"),
    ("page_verify_option_desc", "CHECKSUM", " *** SET PAGE_VERIFY CHECKSUM ***"),
    ("is_auto_create_stats_on", False, " * Enable AUTO_CREATE_STATISTICS *"),
    ("is_auto_update_stats_on", False, " * Enable AUTO_UPDATE_STATISTICS *"),
    ("is_trustworthy_on", True, " * TRUSTWORTHY is on — security risk *"),
    ("is_db_chaining_on", True, " * DB_CHAINING is on — review *"),
]


def settings_audit(databases: DataFrame) -> DataFrame:
    """All warnings of a database in one text."""
    wrong = lambda c, v: F.col(c) != v if isinstance(v, str) else F.col(c) == F.lit(v)
    parts = [F.when(wrong(c, v), t).otherwise("") for c, v, t in SETTING_WARNINGS]
    return databases.where("state_desc = 'ONLINE'").withColumn("warnings", F.concat(*parts))


def unused(databases: DataFrame, usage: DataFrame, since, key: str = "database_id") -> DataFrame:
    """Databases without a seek, scan or lookup after ``since``; of the three, the first known time counts."""
    last = F.coalesce("last_user_seek", "last_user_scan", "last_user_lookup")
    return databases.join(usage.where(last > since).select(key).distinct(), key, "left_anti")


def feature_counts(counters: DataFrame) -> DataFrame:
    return counters.where(like("object_name", "%Deprecated Features%", ignore_case=True) & (F.col("cntr_value") > 0)).select(
        F.col("instance_name").alias("deprecated_feature"), F.col("cntr_value").alias("usage_count"))


# --- encryption ------------------------------------------------------------

def cert_status(as_of, warn_days: int | None = 90) -> Column:
    days = boundaries("day", as_of, "expiry_date")
    steps = [(F.col("expiry_date") < as_of, "*** EXPIRED ***"), (days < 30, "*** EXPIRING SOON ***")]
    return rules(steps + ([(days < warn_days, "* Warning *")] if warn_days else []), "OK")


def cert_expiry(certificates: DataFrame, as_of) -> DataFrame:
    return certificates.withColumns({"days_until_expiry": boundaries("day", as_of, "expiry_date"), "status": cert_status(as_of)})


def encryption_status(keys: DataFrame, databases: DataFrame, certificates: DataFrame, as_of) -> DataFrame:
    return (keys.join(databases, "database_id", "left").join(certificates, F.col("encryptor_thumbprint") == F.col("thumbprint"), "left")
            .withColumns({"state_text": decode("encryption_state", V.ENCRYPTION_STATES), "days_until_expiry": boundaries("day", as_of, "expiry_date"), "cert_status": cert_status(as_of, None)}))


def unencrypted(databases: DataFrame, keys: DataFrame, first_user_db: int = 4) -> DataFrame:
    return (databases.where((F.col("database_id") > first_user_db) & (F.col("state_desc") == "ONLINE")).join(keys.select("database_id"), "database_id", "left_anti")
            .withColumn("encryption", F.lit("NOT ENCRYPTED")))
