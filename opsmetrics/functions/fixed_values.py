"""Names, codes, limits and labels that reports must show exactly as they are."""

# Wait types that mean an idle or housekeeping task.
BENIGN_WAITS = """
AZURE_IMDS_VERSIONS BROKER_EVENTHANDLER BROKER_RECEIVE_WAITFOR BROKER_TASK_STOP BROKER_TO_FLUSH
BROKER_TRANSMITTER CHECKPOINT_QUEUE CHKPT CLR_AUTO_EVENT CLR_MANUAL_EVENT CLR_SEMAPHORE CXCONSUMER
DBMIRROR_DBM_EVENT DBMIRROR_EVENTS_QUEUE DBMIRROR_WORKER_QUEUE DBMIRRORING_CMD DIRTY_PAGE_POLL
DISPATCHER_QUEUE_SEMAPHORE EXECSYNC FSAGENT FT_IFTS_SCHEDULER_IDLE_WAIT FT_IFTSHC_MUTEX
HADR_CLUSAPI_CALL HADR_FILESTREAM_IOMGR_IOCOMPLETION HADR_LOGCAPTURE_WAIT HADR_NOTIFICATION_DEQUEUE
HADR_TIMER_TASK HADR_WORK_QUEUE KSOURCE_WAKEUP LAZYWRITER_SLEEP LOGMGR_QUEUE MEMORY_ALLOCATION_EXT
ONDEMAND_TASK_QUEUE PARALLEL_REDO_DRAIN_WORKER PARALLEL_REDO_LOG_CACHE PARALLEL_REDO_TRAN_LIST
PARALLEL_REDO_WORKER_SYNC PARALLEL_REDO_WORKER_WAIT_WORK POPULATE_LOCK_ORDINALS
PREEMPTIVE_HADR_LEASE_MECHANISM PREEMPTIVE_SP_SERVER_DIAGNOSTICS PREEMPTIVE_OS_LIBRARYOPS
PREEMPTIVE_OS_COMOPS PREEMPTIVE_OS_CRYPTOPS PREEMPTIVE_OS_PIPEOPS PREEMPTIVE_OS_AUTHENTICATIONOPS
PREEMPTIVE_OS_GENERICOPS PREEMPTIVE_OS_VERIFYTRUST PREEMPTIVE_OS_DELETESECURITYCONTEXT
PREEMPTIVE_OS_REPORTEVENT PREEMPTIVE_OS_FILEOPS PREEMPTIVE_OS_DEVICEOPS PREEMPTIVE_OS_QUERYREGISTRY
PREEMPTIVE_OS_WRITEFILE PREEMPTIVE_OS_WRITEFILEGATHER PREEMPTIVE_OS_FLUSHFILEBUFFERS
PREEMPTIVE_XE_CALLBACKEXECUTE PREEMPTIVE_XE_DISPATCHER PREEMPTIVE_XE_GETTARGETSTATE
PREEMPTIVE_XE_SESSIONCOMMIT PREEMPTIVE_XE_TARGETINIT PREEMPTIVE_XE_TARGETFINALIZE PVS_PREALLOCATE
PWAIT_ALL_COMPONENTS_INITIALIZED PWAIT_DIRECTLOGCONSUMER_GETNEXT PWAIT_EXTENSIBILITY_CLEANUP_TASK
QDS_PERSIST_TASK_MAIN_LOOP_SLEEP QDS_ASYNC_QUEUE QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP
QDS_SHUTDOWN_QUEUE REDO_THREAD_PENDING_WORK REQUEST_FOR_DEADLOCK_SEARCH RESOURCE_QUEUE
SERVER_IDLE_CHECK SLEEP_BPOOL_FLUSH SLEEP_DBSTARTUP SLEEP_DCOMSTARTUP SLEEP_MASTERDBREADY
SLEEP_MASTERMDREADY SLEEP_MASTERUPGRADED SLEEP_MSDBSTARTUP SLEEP_SYSTEMTASK SLEEP_TASK
SLEEP_TEMPDBSTARTUP SNI_HTTP_ACCEPT SOS_WORK_DISPATCHER SOS_WORKER_MIGRATION VDI_CLIENT_OTHER
SP_SERVER_DIAGNOSTICS_SLEEP SQLTRACE_BUFFER_FLUSH SQLTRACE_INCREMENTAL_FLUSH_SLEEP
SQLTRACE_WAIT_ENTRIES STARTUP_DEPENDENCY_MANAGER WAIT_FOR_RESULTS WAITFOR WAITFOR_TASKSHUTDOWN
WAIT_XTP_CKPT_CLOSE WAIT_XTP_HOST_WAIT WAIT_XTP_OFFLINE_CKPT_NEW_LOG WAIT_XTP_RECOVERY
XE_BUFFERMGR_ALLPROCESSED_EVENT XE_DISPATCHER_JOIN XE_DISPATCHER_WAIT XE_LIVE_TARGET_TVF XE_TIMER_EVENT
""".split()

# The shorter list behind the highest-overall and latest-two-samples reports.
IGNORABLE_WAITS = """
REQUEST_FOR_DEADLOCK_SEARCH SQLTRACE_INCREMENTAL_FLUSH_SLEEP SQLTRACE_BUFFER_FLUSH LAZYWRITER_SLEEP
XE_TIMER_EVENT XE_DISPATCHER_WAIT FT_IFTS_SCHEDULER_IDLE_WAIT LOGMGR_QUEUE CHECKPOINT_QUEUE
BROKER_TO_FLUSH BROKER_TASK_STOP BROKER_EVENTHANDLER SLEEP_TASK WAITFOR DBMIRROR_DBM_MUTEX
DBMIRROR_EVENTS_QUEUE DBMIRRORING_CMD DISPATCHER_QUEUE_SEMAPHORE BROKER_RECEIVE_WAITFOR
CLR_AUTO_EVENT DIRTY_PAGE_POLL HADR_FILESTREAM_IOMGR_IOCOMPLETION ONDEMAND_TASK_QUEUE
FT_IFTSHC_MUTEX CLR_MANUAL_EVENT SP_SERVER_DIAGNOSTICS_SLEEP
QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP QDS_PERSIST_TASK_MAIN_LOOP_SLEEP
""".split()

WAIT_GUIDANCE = {
    "CXPACKET": "Parallelism — review MAXDOP and Cost Threshold for Parallelism",
    "CXCONSUMER": "Parallelism consumer — often paired with CXPACKET",
    "PAGEIOLATCH_SH": "Data page read I/O — check storage latency and buffer pool pressure",
    "PAGEIOLATCH_EX": "Data page write I/O — check storage latency",
    "WRITELOG": "Transaction log write latency — check log disk performance",
    "IO_COMPLETION": "Non-data-page I/O — check storage subsystem",
    "SOS_SCHEDULER_YIELD": "CPU pressure — queries consuming CPU without yielding",
    "RESOURCE_SEMAPHORE": "Memory grant waits — queries waiting for memory to execute",
    "LCK_M_S": "Shared lock wait — blocking on reads",
    "LCK_M_X": "Exclusive lock wait — blocking on writes",
    "LCK_M_IX": "Intent exclusive lock wait — blocking contention",
    "LCK_M_U": "Update lock wait — blocking contention",
    "LCK_M_SCH_M": "Schema modification lock — DDL blocking",
    "LCK_M_SCH_S": "Schema stability lock — DDL blocking reads",
    "PAGELATCH_EX": "In-memory page contention — often tempdb allocation pages",
    "PAGELATCH_SH": "In-memory page contention — check tempdb config",
    "PAGELATCH_UP": "In-memory page contention — check tempdb config",
    "ASYNC_NETWORK_IO": "Client not consuming results fast enough — check app/network",
    "THREADPOOL": "*** CRITICAL: Worker thread exhaustion — increase max worker threads or reduce load ***",
    "LATCH_EX": "Non-page latch contention — investigate latch class",
    "LATCH_SH": "Non-page latch contention — investigate latch class",
    "OLEDB": "OLE DB call — linked servers, DBCC, or DMVs",
    "CMEMTHREAD": "Memory object contention — may need trace flag 8048",
    "TRACEWRITE": "Trace/XE write bottleneck",
    "PREEMPTIVE_OS_PIPEOPS": "Named pipe operations — check connectivity",
}

# Wait categories: ordered patterns, then names that count as ignorable.
CATEGORY_PATTERNS = [
    ("LCK%", "Locks"),
    ("PAGEIO%", "Page I/O Latch"),
    ("PAGELATCH%", "Page Latch (non-I/O)"),
    ("LATCH%", "Latch (non-buffer)"),
    ("IO_COMPLETION", "I/O Completion"),
    ("ASYNC_NETWORK_IO", "Network I/O (client fetch)"),
    ("CMEMTHREAD", "Memory"),
    ("SOS_RESERVEDMEMBLOCKLIST", "Memory"),
    ("RESOURCE_SEMAPHORE", "Memory"),
    ("RESOURCE_SEMAPHORE_%", "Compilation"),
    ("MSQL_XP", "XProc"),
    ("WRITELOG", "Writelog"),
]
CATEGORY_IGNORABLE = """
DISPATCHER_QUEUE_SEMAPHORE FT_IFTS_SCHEDULER_IDLE_WAIT WAITFOR EXECSYNC SQLTRACE_INCREMENTAL_FLUSH_SLEEP
XE_TIMER_EVENT XE_DISPATCHER_WAIT WAITFOR_TASKSHUTDOWN WAIT_FOR_RESULTS SQLTRACE_BUFFER_FLUSH
SNI_HTTP_ACCEPT SLEEP_TEMPDBSTARTUP SLEEP_TASK SLEEP_SYSTEMTASK SLEEP_MSDBSTARTUP SLEEP_DCOMSTARTUP
SLEEP_DBSTARTUP SLEEP_BPOOL_FLUSH SERVER_IDLE_CHECK RESOURCE_QUEUE REQUEST_FOR_DEADLOCK_SEARCH
ONDEMAND_TASK_QUEUE LOGMGR_QUEUE LAZYWRITER_SLEEP KSOURCE_WAKEUP FSAGENT CLR_MANUAL_EVENT CLR_AUTO_EVENT
CHKPT CHECKPOINT_QUEUE BROKER_TO_FLUSH BROKER_TASK_STOP BROKER_TRANSMITTER BROKER_RECEIVE_WAITFOR
BROKER_EVENTHANDLER DBMIRROR_EVENTS_QUEUE DBMIRROR_DBM_EVENT DBMIRRORING_CMD DBMIRROR_WORKER_QUEUE
RESOURCE_GOVERNOR_IDLE PREEMPTIVE_OS_CRYPTOPS VDI_CLIENT_OTHER
""".split()

# Categories left out of the top five; CPU waits come back as the CPU row.
CPU_WAIT = "SOS_SCHEDULER_YIELD"
TOP_CATEGORY_IGNORE = """
SOS_SCHEDULER_YIELD SP_SERVER_DIAGNOSTICS_SLEEP QDS_PERSIST_TASK_MAIN_LOOP_SLEEP
HADR_FILESTREAM_IOMGR_IOCOMPLETION DIRTY_PAGE_POLL HADR_NOTIFICATION_DEQUEUE HADR_WORK_QUEUE
HADR_CLUSAPI_CALL HADR_TIMER_TASK SOS_WORK_DISPATCHER PWAIT_EXTENSIBILITY_CLEANUP_TASK
XE_LIVE_TARGET_TVF QDS_ASYNC_QUEUE HADR_FABRIC_CALLBACK PVS_PREALLOCATE
""".split()

LATCH_NOTES = {
    "BUFFER": "Buffer pool page — likely tempdb contention if paired with PAGELATCH",
    "ACCESS_METHODS_DATASET_PARENT": "Parallel scan coordination",
    "FGCB_ADD_REMOVE": "File group management — check autogrow events",
    "LOG_MANAGER": "Log manager — transaction log contention",
    "DBCC_MULTIOBJECT_SCANNER": "DBCC operation in progress",
}

SIGNAL_BANDS = [
    (20, "*** CPU PRESSURE DETECTED — investigate top CPU queries ***"),
    (10, "* Moderate signal waits — monitor CPU utilization *"),
]
SIGNAL_OK = "OK — CPU is not the primary bottleneck"

# Performance counters shown by default.
KEY_COUNTERS = [
    "Buffer cache hit ratio", "Buffer cache hit ratio base", "Page life expectancy", "Batch Requests/Sec",
    "SQL Compilations/Sec", "SQL Re-Compilations/Sec", "User Connections", "Page Splits/sec",
    "Processes blocked", "Free pages", "Checkpoint pages/sec", "Logreader:Delivery Latency",
    "Dist:Delivery Latency",
]

# Storage tiers: size in GB, operations per second, MB per second.
STORAGE_TIERS = [
    (129, 500, 100), (513, 2300, 150), (1025, 5000, 200),
    (2049, 7500, 250), (4097, 7500, 250), (8192, 12500, 480),
]

READ_BANDS = [
    (5, "Excellent (<5ms)"), (10, "Good (5-10ms)"), (20, "Acceptable (10-20ms)"), (50, "* Slow (20-50ms) *"),
]
READ_SLOWEST = "*** VERY SLOW (>50ms) — investigate storage ***"
LOG_WRITE_BANDS = [
    (2, "Excellent (<2ms)"), (5, "Good (2-5ms)"), (15, "* Moderate (5-15ms) — review disk config *"),
]
LOG_WRITE_SLOWEST = "*** HIGH LATENCY (>15ms) — impacting transaction throughput ***"

LOW_SPACE_BANDS = [(10, "*** LOW SPACE ***"), (20, "* Warning *")]
PAGE_LIFE_BANDS = [(300, "*** CRITICAL ***"), (1000, "* Warning *")]
GROWTH_EVENTS = ["Data File Auto Grow", "Log File Auto Grow", "Data File Auto Shrink", "Log File Auto Shrink"]
LOG_REUSE_ORDER = {"NOTHING": 99, "LOG_BACKUP": 1, "ACTIVE_TRANSACTION": 2, "REPLICATION": 3}

BACKUP_TYPES = {"D": "Full", "I": "Differential", "L": "Log"}
PAGE_ERRORS = {
    1: "823 error (I/O error)", 2: "Bad checksum", 3: "Torn page",
    4: "Restored (after repair)", 5: "Repaired (DBCC)", 7: "Deallocated (DBCC)",
}
JOB_STATUS = {0: "Failed", 1: "Success", 2: "Retry", 3: "Canceled", 4: "In progress"}
SUBSCRIPTION_STATUS = {0: "Inactive", 1: "Subscribed", 2: "Active"}
ENCRYPTION_STATES = {
    0: "No encryption key", 1: "Unencrypted", 2: "Encryption in progress", 3: "Encrypted",
    4: "Key change in progress", 5: "Decryption in progress", 6: "Protection change in progress",
}
ISOLATION_LEVELS = {
    0: "Unspecified", 1: "ReadUncommitted", 2: "ReadCommitted", 3: "Repeatable", 4: "Serializable", 5: "Snapshot",
}
TRANSACTION_STATES = {
    0: "Initalizing", 1: "Initalized but not Started", 2: "Active",
    3: "Transaction Ended (applicable to read-only Transaction)",
    4: "Commit process has been initiated on the distributed transaction",
    5: "In prepare state", 6: "Committed", 7: "Rolling back", 8: "Rolled Back",
}

# Job schedules.
FREQUENCY_TYPES = {
    1: "Once", 4: "Daily", 8: "Weekly", 16: "Monthly", 32: "Monthly relative",
    64: "When SQL Server Agent starts", 128: "Start whenever the CPU(s) become idle",
}
WEEKDAY_BITS = {1: "Sunday", 2: "Monday", 4: "Tuesday", 8: "Wednesday", 16: "Thursday", 32: "Friday", 64: "Saturday"}
RELATIVE_WEEKS = {1: "First", 2: "Second", 4: "Third", 8: "Fourth", 16: "Last"}
RELATIVE_DAYS = {
    1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday", 5: "Thursday", 6: "Friday", 7: "Saturday",
    8: "Day", 9: "Weekday", 10: "Weekend Day",
}
SUBDAY_UNITS = {2: "Seconds(s)", 4: "Minute(s)", 8: "Hour(s)"}

NOT_AVAILABLE = " -- N/A -- "
PARALLEL_WAITS = ["EXCHANGE", "CXPACKET"]
IDLE_STATUS = ["background", "sleeping"]
IDLE_COMMANDS = ["AWAITING COMMAND", "MIRROR HANDLER", "LAZY WRITER", "CHECKPOINT SLEEP", "RA MANAGER"]
BACKUP_COMMANDS = ["BACKUP DATABASE", "RESTORE DATABASE", "BACKUP LOG", "RESTORE LOG"]
MISSING_INDEX_TOKEN = "<MissingIndexes>"
UNLIMITED_MEMORY_MB = 2147483647

#: Columns of the database posture, in the order shown.
POSTURE = ["state_desc", "user_access_desc", "recovery_model_desc", "log_reuse_wait_desc", "compatibility_level", "page_verify_option_desc",
           "is_read_only", "is_auto_close_on", "is_auto_shrink_on", "is_auto_create_stats_on", "is_auto_update_stats_on",
           "is_auto_update_stats_async_on"]

#: Memory counters by the object that has them.
MEMORY_COUNTERS = {
    "Buffer Manager": ["Page life expectancy", "Free list stalls/sec"],
    "Memory Manager": ["Memory Grants Pending", "Memory Grants Outstanding"],
}
