"""Group K.9, first part: principals, permissions, configuration, certificates."""

from pyspark.sql import functions as F

from ..plans import security as P
from ..functions.scalars import decode
from .fixtures import events_as_of, orders_as_of
from .registry import query


@query("k104_orphaned_users", """
SELECT doc_id AS sid, 'ALTER USER [' || source || '] WITH LOGIN = [' || source || '];' AS fix_command FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'de'""")
def _(t):
    users = t.documents.select(F.col("doc_id").alias("sid"), F.col("source").alias("name"), F.when(F.col("lang") == "de", "R").otherwise("S").alias("type"), F.lit(1).alias("authentication_type"))
    return P.orphaned_users(users, t.labels.select(F.col("doc_id").alias("sid"))).select("sid", "fix_command")


@query("k104_default_db", """
SELECT o_orderkey AS login, CASE WHEN s_suppkey IS NULL THEN '*** DEFAULT DB DOES NOT EXIST ***' WHEN s_acctbal < 0 THEN '*** DEFAULT DB IS OFFLINE ***' ELSE 'OK' END AS status FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""")
def _(t):
    logins = t.orders.select(F.col("o_orderkey").alias("login"), F.col("o_custkey").alias("default_database_name"))
    dbs = t.supplier.select(F.col("s_suppkey").alias("name"), F.when(F.col("s_acctbal") < 0, "OFFLINE").otherwise("ONLINE").alias("state_desc"))
    return P.default_db_check(logins, dbs).select("login", "status")


def principals(t):
    return t.customer.select(F.col("c_custkey").alias("principal_id"), F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("##"), "c_name")).otherwise(F.col("c_name")).alias("name"))


PRINCIPALS = "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN '##' || c_name ELSE c_name END AS name FROM customer"


@query("k105_role_members", f"""
SELECT o_orderkey, r.name AS role_name, m.name AS member_name FROM orders JOIN ({PRINCIPALS}) r ON r.id = o_custkey // 10 JOIN ({PRINCIPALS}) m ON m.id = o_custkey""")
def _(t):
    from ..functions.scalars import int_div

    members = t.orders.select("o_orderkey", int_div("o_custkey", 10).alias("role_principal_id"), F.col("o_custkey").alias("member_principal_id"))
    return P.role_members(members, principals(t)).select("o_orderkey", "role_name", "member_name")


@query("k105_role_member_counts", f"""
SELECT p.id AS principal_id, CAST(count(o_orderkey) AS BIGINT) AS members FROM ({PRINCIPALS}) p LEFT JOIN orders ON o_custkey // 10 = p.id GROUP BY 1""")
def _(t):
    from ..functions.scalars import int_div

    members = t.orders.select(int_div("o_custkey", 10).alias("role_principal_id"), F.col("o_custkey").alias("member_principal_id"))
    return P.role_member_counts(members, principals(t)).select("principal_id", "members")


@query("k105_permissions", f"""
SELECT o_orderkey, o_orderstatus AS state_desc, a.name AS grantee_name, b.name AS grantor_name FROM orders JOIN ({PRINCIPALS}) a ON a.id = o_custkey JOIN ({PRINCIPALS}) b ON b.id = o_custkey // 10 WHERE a.name NOT LIKE '##%'""")
def _(t):
    from ..functions.scalars import int_div

    grants = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("state_desc"), F.col("o_custkey").alias("grantee_principal_id"), int_div("o_custkey", 10).alias("grantor_principal_id"))
    return P.permissions(grants, principals(t)).select("o_orderkey", "state_desc", "grantee_name", "grantor_name")


@query("k105_object_permissions", f"""
SELECT o_orderkey, a.name AS grantee_name, CASE WHEN s_suppkey IS NULL THEN '' ELSE 'n' || s_nationkey || '.' || s_name END AS object_name FROM orders JOIN ({PRINCIPALS}) a ON a.id = o_custkey
LEFT JOIN supplier ON s_suppkey = o_custkey AND o_orderstatus = 'F' WHERE a.name NOT LIKE '##%'""")
def _(t):
    grants = t.orders.select("o_orderkey", F.col("o_custkey").alias("grantee_principal_id"), F.col("o_custkey").alias("major_id"), F.when(F.col("o_orderstatus") == "F", "OBJECT_OR_COLUMN").otherwise("DATABASE").alias("class_desc"))
    objects = t.supplier.select(F.col("s_suppkey").alias("object_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("schema_name"), F.col("s_name").alias("name"))
    return P.object_permissions(grants, principals(t), objects).select("o_orderkey", "grantee_name", "object_name")


@query("k106_policy_audit", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'MACHINERY' THEN '*** BOTH DISABLED ***' WHEN c_acctbal < 0 THEN '* Policy off *' ELSE '* Expiration off *' END AS warning FROM customer
WHERE (c_acctbal < 0 OR c_mktsegment = 'MACHINERY') AND c_acctbal < 9000""")
def _(t):
    logins = t.customer.select("c_custkey", F.col("c_name").alias("name"), (F.col("c_acctbal") >= 0).alias("is_policy_checked"), (F.col("c_mktsegment") != "MACHINERY").alias("is_expiration_checked"), (F.col("c_acctbal") >= 9000).alias("is_disabled"))
    return P.policy_audit(logins).select("c_custkey", "warning")


def connect_grants(t):
    return t.orders.select("o_orderkey", F.col("o_custkey").alias("grantee_principal_id"), decode("o_orderstatus", {"F": "CONNECT SQL", "O": "CONNECT"}, "VIEW").alias("permission_name"),
                           F.when(F.col("o_orderpriority") == "1-URGENT", "DENY").otherwise("GRANT").alias("state_desc"), (F.col("o_custkey") % 10).alias("database_id"))


@query("k106_denied_logins", "SELECT o_orderkey, c_name AS login_name, '*** LOGIN DENIED CONNECT SQL ***' AS status FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(t):
    people = t.customer.select(F.col("c_custkey").alias("principal_id"), F.col("c_name").alias("name"))
    return P.denied_logins(connect_grants(t), people).select("o_orderkey", "login_name", "status")


@query("k106_guest_access", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AND o_custkey % 10 > 4 AND c_mktsegment = 'BUILDING'")
def _(t):
    people = t.customer.select(F.col("c_custkey").alias("principal_id"), F.when(F.col("c_mktsegment") == "BUILDING", "guest").otherwise(F.col("c_name")).alias("name"))
    return P.guest_access(connect_grants(t), people).select("o_orderkey")


@query("k106_linked_servers", "SELECT s_suppkey AS server_id, o_orderkey AS mapping, c_name AS local_login FROM supplier LEFT JOIN orders ON o_custkey = s_suppkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey WHERE s_acctbal >= 0")
def _(t):
    servers = t.supplier.select(F.col("s_suppkey").alias("server_id"), (F.col("s_acctbal") >= 0).alias("is_linked"))
    maps = t.orders.select(F.col("o_custkey").alias("server_id"), F.col("o_orderkey").alias("mapping"), F.col("o_custkey").alias("local_principal_id"))
    people = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("principal_id"), F.col("c_name").alias("name"))
    return P.linked_servers(servers, maps, people).select("server_id", "mapping", "local_login")


@query("k107_compare_roles", "SELECT right(c_name, 3) AS role_name, s.n AS role_name_2 FROM customer LEFT JOIN (SELECT DISTINCT right(s_name, 3) AS n FROM supplier) s ON s.n = right(c_name, 3) WHERE c_acctbal >= 0")
def _(t):
    a = t.customer.select(F.right("c_name", F.lit(3)).alias("name"), (F.col("c_acctbal") >= 0).alias("is_role"))
    return P.compare_roles(a, t.supplier.select(F.right("s_name", F.lit(3)).alias("name")))


@query("k107_user_mapping", "SELECT s_name AS login_name, a.c_name AS user_name, b.c_name AS role_name FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = o_custkey // 10 JOIN supplier ON s_suppkey = a.c_nationkey")
def _(t):
    from ..functions.scalars import int_div

    users = t.customer.select(F.col("c_custkey").alias("principal_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("sid"))
    members = t.orders.select(int_div("o_custkey", 10).alias("role_principal_id"), F.col("o_custkey").alias("member_principal_id"))
    return P.user_mapping(users, members, t.supplier.select(F.col("s_suppkey").alias("sid"), F.col("s_name").alias("name")))


def record(t, body):
    return t.events.select(F.concat(F.lit('<Record id="'), F.col("event_id").cast("string"), F.lit('" type="X" time="5">'), body, F.lit("</Record>")).alias("record"), (F.col("event_id") * 977).alias("timestamp"))


def tag(name, c):
    return F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))


AT = "TIMESTAMP '2024-01-31' - to_milliseconds(100000000 - event_id * 977)"


@query("k108_login_failures", f"SELECT event_id AS record_id, {AT} AS notification_time, user_id AS spid, '0x139F' AS error_code, event_type AS calling_api, CAST(NULL AS VARCHAR) AS api, 'X' AS type FROM events")
def _(t):
    body = F.concat(F.lit("<Error>"), tag("SPID", F.col("user_id")), tag("ErrorCode", F.lit("0x139F")), tag("CallingAPIName", F.col("event_type")), F.lit("</Error>"))
    return P.login_failures(record(t, body), F.lit(100000000), events_as_of())


@query("k108_connectivity", f"SELECT event_id AS record_id, {AT} AS time_stamp, event_type AS action, CAST(user_id AS INTEGER) AS spid, CAST(floor(value) AS INTEGER) AS read_error, CAST(NULL AS INTEGER) AS normal_logout FROM events WHERE user_id <> 0")
def _(t):
    body = F.concat(F.lit("<ConnectivityTraceRecord>"), tag("RecordType", F.col("event_type")), tag("Spid", F.col("user_id")), F.lit("<TdsDisconnectFlags>"), tag("DisconnectDueToReadError", F.floor("value")), F.lit("</TdsDisconnectFlags></ConnectivityTraceRecord>"))
    return P.connectivity(record(t, body), F.lit(100000000), events_as_of()).select("record_id", "time_stamp", "action", "spid", "read_error", "normal_logout")


RULE_SQL = " ".join(f"WHEN '{name}' THEN " + ("CASE " + " ".join(f"WHEN v {op.replace('==', '=')} {cut} THEN '{text}'" for op, cut, text in steps) + " ELSE " if steps else "")
                    + "'" + rest.replace("{}", "' || v || '") + "'" + (" END" if steps else "") for name, (steps, rest) in P.CONFIG_RULES.items())
NAMES = list(P.CONFIG_RULES)
NAME_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES + ["unlisted"]) + "]"


@query("k109_config_audit", f"SELECT p_partkey, name, CASE name {RULE_SQL} END AS recommendation FROM (SELECT p_partkey, {NAME_SQL}[p_partkey % {len(NAMES) + 1} + 1] AS name, p_size % 12 AS v FROM part) WHERE name <> 'unlisted'")
def _(t):
    names = F.array(*[F.lit(n) for n in NAMES + ["unlisted"]])
    settings = t.part.select("p_partkey", F.get(names, (F.col("p_partkey") % (len(NAMES) + 1)).cast("int")).alias("name"), (F.col("p_size") % 12).alias("value_in_use"))
    return P.config_audit(settings).select("p_partkey", "name", "recommendation")


@query("k110_settings_audit", """
SELECT c_custkey, CASE WHEN c_acctbal < 500 THEN '*** DISABLE AUTO_CLOSE ***' ELSE '' END || CASE WHEN c_acctbal > 5000 THEN ' *** DISABLE AUTO_SHRINK ***' ELSE '' END || CASE WHEN c_mktsegment <> 'BUILDING' THEN ' *** SET PAGE_VERIFY CHECKSUM ***' ELSE '' END
  || CASE WHEN c_mktsegment = 'MACHINERY' THEN ' * Enable AUTO_CREATE_STATISTICS *' ELSE '' END || CASE WHEN c_nationkey = 7 THEN ' * TRUSTWORTHY is on — security risk *' ELSE '' END AS warnings FROM customer""")
def _(t):
    c = F.col
    dbs = t.customer.select("c_custkey", F.lit("ONLINE").alias("state_desc"), (c("c_acctbal") < 500).alias("is_auto_close_on"), (c("c_acctbal") > 5000).alias("is_auto_shrink_on"), F.when(c("c_mktsegment") == "BUILDING", "CHECKSUM").otherwise("NONE").alias("page_verify_option_desc"),
                            (c("c_mktsegment") != "MACHINERY").alias("is_auto_create_stats_on"), F.lit(True).alias("is_auto_update_stats_on"), (c("c_nationkey") == 7).alias("is_trustworthy_on"), F.lit(False).alias("is_db_chaining_on"))
    return P.settings_audit(dbs).select("c_custkey", "warnings")


@query("k111_unused", "SELECT c_custkey AS database_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01')")
def _(t):
    usage = t.orders.select(F.col("o_custkey").alias("database_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("last_user_seek"), F.col("o_orderdate").alias("last_user_scan"), F.lit(None).cast("timestamp_ntz").alias("last_user_lookup"))
    return P.unused(t.customer.select(F.col("c_custkey").alias("database_id")), usage, F.expr("timestamp_ntz'2001-01-01'"))


@query("k111_feature_counts", "SELECT CAST(event_id AS VARCHAR) AS deprecated_feature, floor(value / 10) AS usage_count FROM events WHERE event_type = 'error' AND floor(value / 10) > 0")
def _(t):
    rows = t.events.select(F.when(F.col("event_type") == "error", "Stats:Deprecated Features").otherwise("Stats").alias("object_name"), F.col("event_id").cast("string").alias("instance_name"), F.floor(F.col("value") / 10).cast("double").alias("cntr_value"))
    return P.feature_counts(rows)


STATUS = "CASE WHEN o_orderdate < TIMESTAMP '1999-06-01 12:00:00' THEN '*** EXPIRED ***' WHEN date_diff('day', TIMESTAMP '1999-06-01 12:00:00', o_orderdate) < 30 THEN '*** EXPIRING SOON ***' {warn} ELSE 'OK' END"


def noon():
    return F.expr("timestamp_ntz'1999-06-01 12:00:00'")


@query("k112_cert_expiry", f"""
SELECT o_orderkey, date_diff('day', TIMESTAMP '1999-06-01 12:00:00', o_orderdate) AS days_until_expiry, {STATUS.format(warn="WHEN date_diff('day', TIMESTAMP '1999-06-01 12:00:00', o_orderdate) < 90 THEN '* Warning *'")} AS status FROM orders""")
def _(t):
    return P.cert_expiry(t.orders.select("o_orderkey", F.col("o_orderdate").alias("expiry_date")), noon()).drop("expiry_date")


@query("k112_encryption_status", f"""
SELECT l_orderkey, l_partkey, CASE l_linenumber WHEN 1 THEN 'Unencrypted' WHEN 2 THEN 'Encryption in progress' WHEN 3 THEN 'Encrypted' WHEN 4 THEN 'Key change in progress' WHEN 5 THEN 'Decryption in progress' WHEN 6 THEN 'Protection change in progress' END AS state_text,
  s_name AS database_name, {STATUS.format(warn='')} AS cert_status FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey""")
def _(t):
    keys = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("database_id"), F.col("l_linenumber").alias("encryption_state"), F.col("l_orderkey").alias("encryptor_thumbprint"))
    dbs = t.supplier.select(F.col("s_suppkey").alias("database_id"), F.col("s_name").alias("database_name"))
    certs = t.orders.select(F.col("o_orderkey").alias("thumbprint"), F.col("o_orderdate").alias("expiry_date"))
    return P.encryption_status(keys, dbs, certs, noon()).select("l_orderkey", "l_partkey", "state_text", "database_name", "cert_status")


@query("k112_unencrypted", "SELECT doc_id AS database_id, 'NOT ENCRYPTED' AS encryption FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id > 4")
def _(t):
    dbs = t.documents.select(F.col("doc_id").alias("database_id"), F.lit("ONLINE").alias("state_desc"))
    return P.unencrypted(dbs, t.labels.select(F.col("doc_id").alias("database_id"))).drop("state_desc")
