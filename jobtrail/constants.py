"""Values that results must carry unchanged. Everything in this module is a fixed value."""

# --- fixed values: log scanning -------------------------------------------------
SUBMIT_MARK = "Submitted application"
APP_ID_TAIL = r"^[0-9]{13}_[0-9]{4,}$"
APP_ID_TAIL_STRICT = r"^[0-9]{13}_[0-9]{4}$"
APP_ID_PARTS = r"^application_([0-9]{13})_([0-9]+)$"
STAMP_FORMAT = "yyyy-MM-dd_HH-mm-ss-SSS"
STAMP_FORMAT_SECONDS = "yyyy-MM-dd_HH-mm-ss"
STAMP_PATTERN = r"[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{3}"

# --- fixed values: engines and statuses -----------------------------------------
ENGINES = ("GM", "SK", "MR", "HV")
HIVE_ENGINE = "HV"
SINGLE_MACHINE_ENGINE = "GM"
RUNNING = "RUNNING"
FINISHED = "FINISHED"
SUCCEEDED = "SUCCEEDED"
FAILED = "FAILED"
KILLED = "KILLED"
NOT_EXIST = "NOT_EXIST"
ALREADY_FINISHED = "ALREADY_FINISHED"
HIVE_CANCEL = "HIVE_CANCEL"
KILL_APPLICATION = "KILL_APPLICATION"
HIVE_RUNNING_STATES = ("INITIALIZED_STATE", "RUNNING_STATE", "PENDING_STATE")
HIVE_FINISHED_STATE = "FINISHED_STATE"
HIVE_CANCELED_STATE = "CANCELED_STATE"

# --- fixed values: limits -------------------------------------------------------
MAX_PROPERTY = 128
MAX_FIELD = 64
MAX_TEXT = 1024
BYTES_PER_GB = 1024 * 1024 * 1024
MAX_QUOTA_BYTES = 53687091200
RETENTION_DAYS = 5
DEFAULT_QUEUE = "default"

# --- fixed values: packages -----------------------------------------------------
SUBMIT_JAR = r"Dshell[0-9]\.[0-9]\.[0-9]V[0-9]\.jar"

# --- fixed values: queue settings -----------------------------------------------
QUEUE_PROPERTY_PREFIX = "yarn.scheduler.capacity.root."
NODE_ROLE = "NODEMANAGER"
MASTER_ROLE = "RESOURCEMANAGER"
MEMORY_SETTING = "yarn_nodemanager_resource_memory_mb"
VCORES_SETTING = "yarn_nodemanager_resource_cpu_vcores"

# --- fixed values: names reserved by the function surface ------------------------
SYSTEM_FUNCTIONS = (
    "! != % & * + - / < <= <=> <> = == > >= ^ abs acos and array array_contains ascii asin "
    "assert_true atan avg base64 between bin case ceil ceiling coalesce collect_list collect_set "
    "compute_stats concat concat_ws context_ngrams conv corr cos count covar_pop covar_samp "
    "create_union cume_dist current_database date_add date_sub datediff day dayofmonth decode "
    "degrees dense_rank div e elt encode ewah_bitmap ewah_bitmap_and ewah_bitmap_empty "
    "ewah_bitmap_or exp explode field find_in_set first_value floor format_number from_unixtime "
    "from_utc_timestamp get_json_object hash hex histogram_numeric hour if in in_file index inline "
    "instr isnotnull isnull java_method json_tuple lag last_value lcase lead length like ln locate "
    "log log10 log2 lower lpad ltrim map map_keys map_values matchpath max min minute month "
    "named_struct negative ngrams noop noopwithmap not ntile nvl or parse_url parse_url_tuple "
    "percent_rank percentile percentile_approx pi pmod posexplode positive pow power printf radians "
    "rand rank reflect reflect2 regexp regexp_extract regexp_replace repeat reverse rlike round "
    "row_number rpad rtrim second sentences sign sin size sort_array space split sqrt stack std "
    "stddev stddev_pop stddev_samp str_to_map struct substr substring sum tan to_date "
    "to_unix_timestamp to_utc_timestamp translate trim ucase unbase64 unhex unix_timestamp upper "
    "var_pop var_samp variance weekofyear when windowingtablefunction xpath xpath_boolean "
    "xpath_double xpath_float xpath_int xpath_long xpath_number xpath_short xpath_string year | ~ "
    "default"
).split()

# --- fixed values: messages -----------------------------------------------------
TOO_LONG = "{name}长度不能大于{limit}"
EMPTY_PROPERTY = "the property {name} is null"
NO_CONTEXT = "the context is null"
NO_JOB_INSTANCE = "the Jobinstanceid is null"
NO_USER = "the UserName is null"
NO_PROCESS = "the ProcessId is null"
NO_BASE_PATH = "the tempHdfsBasePath is null"
OPID_NULL = "opid is null"
OPID_SPACE = "operator name contains space"
OPID_NO_DOT = "operator name should contains '.'"
OPID_ENGINE = "operator name should begin with GM,SK,MR,HV"
OPJARPATH_NULL = "opjarpath is null"
ZIP_MISSING = "the hdfs zip(%s) is not exist"
OPID_EXISTS = "the opid '%s' is exist"
OPID_UNKNOWN = "the opid '%s' is not exist"
ZIP_INCOMPLETE = "The ZIP file of '%s' in HDFS  is not completed ."
SUBMIT_JAR_REQUIRED = "该单机算子需要使用DShell提交到YARN执行"
FIELD_NULL = "{name} is null"
UDF_SYSTEM = "thd udfname '%s' is system function, please use a different name."
UDF_EXISTS = "thd udfname '%s' is exist, please use a different name."
UDF_IN_METASTORE = "thd udfname '%s' is exist in HiveMetaStore, please use a different name."
UDF_UNKNOWN_UPDATE = "thd udfname '%s' is not exist"
UDF_UNKNOWN_DELETE = "thd udfname '%s' is not exist."
QUOTA_NULL = "quota is null"
QUOTA_NOT_NUMBER = "quota is not a number"
QUOTA_TOO_LARGE = "quota can not larger than 53687091200"
QUEUE_NAME_MISSING = "queueName is not exist"
MEMTOTAL_MISSING = "memtotal is not exist"
TASK_UNKNOWN = "the optask '%s' is not exist"
INSTANCE_NOT_SUBMITTED = "the opTask(%s) of jobinstanceid( %s)  is not submitted to the yarn"
TASK_FINISHED = "the optask '%s' is FINISHED"
KILL_REFUSED = "the application '%s' is not normal to kill, Please check the operator task status"
NO_APPLICATION_ID = "当前算子标准输出流中没有截获到ApplicationId，请确认是否用了log4j处理日志，应该使用标准输出"
INSTANCE_UNKNOWN = "the opTask(%s) of jobinstanceid(%s) is not exist"
QUEUE_EXISTS = "exist queue: %s"
QUEUE_UNKNOWN = "not exist queue: %s"
TASK_KILLED = "the optask is killed"
NOT_ENOUGH_MEMORY = "The cluster does not have enough memory resource"
MALFORMED = "malformed document"
