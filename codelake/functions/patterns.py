"""The patterns and word lists that decide what counts as an entry point, a mapping, a table or a sink."""

# Entry points, one line at a time: (kind, pattern), in order.
ENTRYPOINTS = [
    ("main", r"\bpublic\s+static\s+void\s+main\s*\(\s*(?:final\s+)?String\s*(?:\[\s*\w*\s*\]|\.\.\.)\s*\w+\s*\)"),
    ("spring_boot_application", r"@SpringBootApplication\b"),
    ("spring_application_run", r"\bSpringApplication\s*\.\s*run\s*\("),
    ("web_application_initializer", r"\bWebApplicationInitializer\b"),
    ("web_servlet", r"@WebServlet\s*\("),
    ("web_filter", r"@WebFilter\s*\("),
    ("web_listener", r"@WebListener\b"),
    ("http_servlet", r"\bextends\b[^{\n:]*\bHttpServlet\b"),
    ("servlet", r"\bimplements\b[^{;]*\b(jakarta\.servlet\.Servlet|javax\.servlet\.Servlet)\b"),
    ("servlet_container_initializer", r"\bimplements\b[^{;]*\bServletContainerInitializer\b"),
    ("kafka_listener", r"@KafkaListener\b"),
    ("rabbit_listener", r"@RabbitListener\b"),
    ("jms_listener", r"@JmsListener\b"),
    ("rocketmq_message_listener", r"@RocketMQMessageListener\b"),
    ("sqs_listener", r"@SqsListener\b"),
    ("stream_listener", r"@StreamListener\b"),
    ("pulsar_listener", r"@PulsarListener\b"),
    ("incoming_channel", r"@Incoming\s*\("),
    ("service_activator", r"@ServiceActivator\b"),
    ("scheduled", r"@Scheduled\b"),
    ("schedules", r"@Schedules\b"),
    ("quartz_job_execute", r"\bvoid\s+execute\s*\(\s*(?:final\s+)?(?:org\.quartz\.)?JobExecutionContext\b"),
    ("xxl_job", r"@XxlJob\b"),
    ("spring_async", r"@Async\b"),
]
BY_KIND = dict(ENTRYPOINTS)

# Markers that end an upward trace: (label, kind above).
LISTENER_MARKERS = [("@KafkaListener", "kafka_listener"), ("@RabbitListener", "rabbit_listener"), ("@JmsListener", "jms_listener"), ("@RocketMQMessageListener", "rocketmq_message_listener"), ("@SqsListener", "sqs_listener"), ("@StreamListener", "stream_listener"), ("@PulsarListener", "pulsar_listener"), ("@Incoming", "incoming_channel"), ("@ServiceActivator", "service_activator")]
SCHEDULED_MARKERS = [("@Scheduled", "scheduled"), ("@Schedules", "schedules"), ("Quartz Job#execute", "quartz_job_execute"), ("@XxlJob", "xxl_job")]
ASYNC_MARKERS = [("@Async", "spring_async")]

# Web mappings.
MAPPINGS = ["GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping"]
MAPPING = r"@(GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)\s*(\([^)]*\))?"
VERB = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
REQUEST_METHOD = r"RequestMethod\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)"
REST_CONTROLLER = r"@(?:[\w.]+\.)*RestController\b"
CONTROLLER = r"@(?:[\w.]+\.)*Controller\b"
CLASS_LINE = r"^\s*(?:public\s+|protected\s+|private\s+)?(?:abstract\s+)?(?:final\s+)?class\s+(\w+)\b"
METHOD_LINE = r"^\s*(?:@\w+\s+)*(?:public|protected|private)\s+[\w<>,?\s\[\]]+\s+(\w+)\s*\("
PUBLIC_METHOD_LINE = r"^\s*(?:@\w+\s+)*public\s+(?:(?:static|final|default|abstract|synchronized|volatile|transient|native|strictfp|sealed|non-sealed)\s+)*[\w<>,?\s\[\]]+\s+(\w+)\s*\("
PACKAGE = r"^\s*package\s+([\w.]+)\s*;"
NOT_METHODS = ["if", "for", "while", "switch", "catch", "try", "new"]

# Methods and declarations.
METHOD_LIKE = r"^\s*(public|private|protected|static)\s+.+\([^)]*\)"
# whatever the two patterns of declarations match, matches this
LIKELY_DECLARATION = r"^\s*[\w.<>,?\[\]][\w.<>,?\[\]\s]*\s\w+\s*\("
NOT_NAMES = ["if", "for", "while", "switch", "catch", "new", "return", "super", "this", "synchronized"]
STATEMENT_STARTS = ["if (", "if(", "for (", "for(", "while (", "while(", "switch (", "catch (", "try {"]
TYPE_WORDS = r"[<>\[\]]|\b(void|int|long|boolean|byte|short|float|double|var)\b"
ACCESSOR = r"^(get|set|is)[A-Za-z_]\w*\s*\("

# Tables in source code.
TABLE_ANNOTATION = r"""@Table\s*\(\s*(?:name\s*=\s*)?["']([^"']+)["']"""
TABLE_ATTRIBUTE = r"""(?i)\btable\s*=\s*["']([^"']+)["']"""
# runs are taken whole and never given back: what may follow one cannot stand in it
DOUBLE_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
SINGLE_QUOTED = r"'([^'\\]*+(?:\\.[^'\\]*+)*+)'"
# the first letter is looked at before anything else, since most places fail there
SQL_HINT = r"(?i)(?=[SIUDF])\b(SELECT|INSERT|UPDATE|DELETE|FROM)\b"
SQL_TABLE = r"(?i)(?=[FJIU])\b(?:FROM|JOIN|INTO|UPDATE)\s+(?!\()\s*([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)"
END_OF_FROM = r"(?i)(?=[WGOHLUF])\b(WHERE|GROUP\s+BY|ORDER\s+BY|HAVING|LIMIT|UNION|OFFSET|FETCH|FOR\s+UPDATE)\b"
SQL_RESERVED = ["DUAL", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "SET", "VALUES", "SELECT", "DISTINCT", "INNER", "LEFT", "RIGHT", "OUTER", "FULL", "CROSS", "ON", "AS", "AND", "OR", "NOT", "NULL", "TRUE", "FALSE", "CASE", "WHEN", "THEN", "ELSE", "END", "BY", "ASC", "DESC", "UNION", "ALL", "BETWEEN", "LIKE", "IN", "EXISTS", "INTO", "FROM", "JOIN", "UPDATE"]
MAPPER_NAMESPACE = r"""(?is)<mapper\b[^>]*\bnamespace\s*=\s*["']([^"']+)["']"""
STATEMENT_ID = r"""(?i)<(?:select|insert|update|delete)\b[^>]*\bid\s*=\s*["']([^"']+)["']"""

# Names.
PHYSICAL_TABLE = r"^[a-z][a-z0-9_]*$"
PASCAL_TYPE = r"^[A-Z][a-zA-Z0-9]+$"

# Sinks of downward traces.
DATABASE_WORDS = ["jdbctemplate", "entitymanager", "namedparameterjdbc", "preparedstatement", ".jpa.", "hibernate", "jpql", "criteriaquery"]
MIDDLEWARE_WORDS = ["kafka", "rabbit", "amqp", "redis", "mongotemplate", "springframework.data.mongodb"]
EXTERNAL_WORDS = ["resttemplate", "webclient", "feign", "openfeign", "httpclient", "okhttp", "retrofit", "webmvc.client"]

# Folders that hold no sources.
SKIPPED_FOLDERS = ["target", "build", ".git", "node_modules", "dist", "out", ".gradle"]
