"""Names and weights that results depend on, as the code-intelligence domain defines them."""

SYMBOL_KINDS = ("class", "interface", "enum", "record", "annotation", "method", "constructor", "file", "package")
TYPE_KINDS = ("class", "interface", "enum", "record", "annotation")
MEMBER_KINDS = ("method", "constructor")

ONTOLOGY_VERSION = 19

ROLE_BY_ANNOTATION = {
    "RestController": "CONTROLLER",
    "Controller": "CONTROLLER",
    "Service": "SERVICE",
    "Repository": "REPOSITORY",
    "Component": "COMPONENT",
    "Configuration": "CONFIG",
    "Entity": "ENTITY",
    "MappedSuperclass": "ENTITY",
    "Embeddable": "ENTITY",
    "FeignClient": "CLIENT",
    "Mapper": "MAPPER",
}

ROLE_WEIGHTS = {
    "CONTROLLER": 0.10,
    "SERVICE": 0.08,
    "CLIENT": 0.06,
    "COMPONENT": 0.03,
    "REPOSITORY": 0.02,
    "MAPPER": 0.00,
    "OTHER": 0.00,
    "ENTITY": -0.06,
    "CONFIG": -0.10,
    "DTO": -0.08,
}

CAPABILITY_BY_METHOD_ANNOTATION = {
    "KafkaListener": "MESSAGE_LISTENER",
    "RabbitListener": "MESSAGE_LISTENER",
    "JmsListener": "MESSAGE_LISTENER",
    "SqsListener": "MESSAGE_LISTENER",
    "EventListener": "MESSAGE_LISTENER",
    "StreamListener": "MESSAGE_LISTENER",
    "Scheduled": "SCHEDULED_TASK",
    "ExceptionHandler": "EXCEPTION_HANDLER",
}
CAPABILITY_BY_TYPE_ANNOTATION = {
    "ControllerAdvice": "EXCEPTION_HANDLER",
    "RestControllerAdvice": "EXCEPTION_HANDLER",
    "FeignClient": "HTTP_CLIENT",
}
CAPABILITY_BY_INJECTED_TYPE = {
    "KafkaTemplate": "MESSAGE_PRODUCER",
    "RabbitTemplate": "MESSAGE_PRODUCER",
    "JmsTemplate": "MESSAGE_PRODUCER",
    "StreamBridge": "MESSAGE_PRODUCER",
    "ApplicationEventPublisher": "MESSAGE_PRODUCER",
}
CAPABILITY_BY_SUPERTYPE = {"Job": "SCHEDULED_TASK"}

HTTP_MAPPINGS = {
    "RequestMapping": "",
    "GetMapping": "GET",
    "PostMapping": "POST",
    "PutMapping": "PUT",
    "DeleteMapping": "DELETE",
    "PatchMapping": "PATCH",
}
#: Listener annotations: kind of route, framework and broker.
LISTENERS = {
    "KafkaListener": ("kafka_topic", "kafka", "kafka"),
    "RabbitListener": ("rabbit_queue", "rabbitmq", "rabbitmq"),
    "JmsListener": ("jms_destination", "jms", "jms"),
    "StreamListener": ("stream_binding", "stream", "stream"),
}
INJECT_ANNOTATIONS = ("Autowired", "Inject", "Resource")
LOMBOK_CONSTRUCTORS = ("RequiredArgsConstructor", "AllArgsConstructor")

EXTERNAL_PREFIXES = ("java.", "javax.", "jakarta.", "org.springframework.", "lombok.")

STOP_WORDS = (
    "a an the is are was were be been being to of in on at by for with from as or and but if then else when what how why does "
    "do did has have had this that these those it its new no not will would should can could may might happens happen happened get gets got"
).split()

ACTION_VERBS = "process handle on pick select assign notify dispatch publish consume route trigger enqueue distribute update create apply resolve reassign close open".split()

RRF_K = 60
IMPORT_PENALTY, IMPORT_FACTOR = 0.08, 0.88
SYMBOL_HIT, SYMBOL_CAP, ACTION_BONUS, TYPE_HIT, TYPE_CAP = 0.03, 0.06, 0.02, 0.05, 0.10
LEXICAL_NAME, LEXICAL_FQN, LEXICAL_TEXT, LEXICAL_TYPE_CAP = 0.45, 0.20, 0.15, 0.10
BM25_K1, BM25_B = 1.2, 0.75

#: Edge types: endpoints and whether they are reached through members.
EDGES = {
    "EXTENDS": ("Symbol", "Symbol", False),
    "IMPLEMENTS": ("Symbol", "Symbol", False),
    "INJECTS": ("Symbol", "Symbol", False),
    "DECLARES": ("Symbol", "Symbol", False),
    "OVERRIDES": ("Symbol", "Symbol", True),
    "CALLS": ("Symbol", "Symbol", True),
    "EXPOSES": ("Symbol", "Route", True),
    "DECLARES_CLIENT": ("Symbol", "Client", True),
    "DECLARES_PRODUCER": ("Symbol", "Producer", True),
    "HTTP_CALLS": ("Client", "Route", False),
    "ASYNC_CALLS": ("Producer", "Route", False),
}
#: Composed keys: one edge after another, with the direction of the first.
COMPOSED = {
    "DECLARES.EXPOSES": ("DECLARES", "out", "EXPOSES"),
    "DECLARES.DECLARES_CLIENT": ("DECLARES", "out", "DECLARES_CLIENT"),
    "DECLARES.DECLARES_PRODUCER": ("DECLARES", "out", "DECLARES_PRODUCER"),
    "OVERRIDDEN_BY": ("OVERRIDES", "in", None),
    "OVERRIDDEN_BY.EXPOSES": ("OVERRIDES", "in", "EXPOSES"),
    "OVERRIDDEN_BY.DECLARES_CLIENT": ("OVERRIDES", "in", "DECLARES_CLIENT"),
    "OVERRIDDEN_BY.DECLARES_PRODUCER": ("OVERRIDES", "in", "DECLARES_PRODUCER"),
}
MATCH_FACTORS = {"cross_service": 1.0, "intra_service": 0.6, "ambiguous": 0.5, "phantom": 0.4, "unresolved": 0.3}
RISK = {"blast": (0.4, 100), "cross": (0.3, 20), "interface": (0.2, 1), "routes": (0.1, 5)}
