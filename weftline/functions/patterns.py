"""What lines of source code show: a table of (languages, signal, expression, reason).

Java regular expressions, matched anywhere in a line.
"""

from __future__ import annotations

JS = ("javascript", "typescript")
ALL = ("python", *JS, "java", "go", "rust", "csharp", "kotlin", "php", "ruby")

PATTERNS: list[tuple[tuple[str, ...], str, str, str]] = [
    # Network clients
    (("python",), "network_io", r"\b(requests|httpx|aiohttp|urllib\.request|urllib3|socket|boto3|grpc)\.\w+", "uses a network client"),
    (JS, "network_io", r"^(?!\s*((export|default|public|private|protected|static|readonly|override|async)\s+)*(function\s+fetch\s*\(|fetch\s*\([^)]*\)\s*\{)).*(?<![\w$.])fetch\s*\(|\baxios(\.[A-Za-z_]\w*)?\s*\(|\bnew\s+(WebSocket|XMLHttpRequest|EventSource)\b|\bhttps?\.(get|request)\s*\(", "uses a network client"),
    (("java",), "network_io", r"\b(RestTemplate|WebClient|HttpClient|OkHttpClient|FeignClient|HttpURLConnection|Socket)\b", "uses a network client"),
    (("go",), "network_io", r"\bhttp\.(Get|Post|PostForm|Head|NewRequest\w*|Client)\b|\bnet\.(Dial|Listen)\w*|\bgrpc\.(Dial|NewClient)\w*", "uses a network client"),
    (("rust",), "network_io", r"\b(reqwest|hyper|tonic)::|\b(TcpStream|UdpSocket|TcpListener)::", "uses a network client"),
    (("csharp",), "network_io", r"\b(HttpClient|WebClient|HttpWebRequest|TcpClient|RestClient)\b|\.(GetAsync|PostAsync|SendAsync|GetStringAsync)\s*\(", "uses a network client"),
    (("kotlin",), "network_io", r"\b(HttpClient|OkHttpClient|WebClient|RestTemplate|Retrofit)\b|\bclient\.(get|post|put|delete)\b", "uses a network client"),
    (("php",), "network_io", r"\bcurl_(init|exec)\s*\(|\bHttp::\w+\s*\(|\bnew\s+(GuzzleHttp\\)?Client\b|file_get_contents\s*\(\s*['\"]https?:", "uses a network client"),
    (("ruby",), "network_io", r"\b(Net::HTTP|Faraday|HTTParty|RestClient|TCPSocket)\b|\bURI\.open\b", "uses a network client"),
    # Databases
    (("python",), "database_io", r"\.(execute|executemany|fetchone|fetchall|commit|rollback)\s*\(|\b(sqlite3|psycopg2?|sqlalchemy|pymongo)\.\w+|\.objects\.(get|filter|create|all)\s*\(|\bfrappe\.db\.\w+", "reads or writes a database"),
    (JS, "database_io", r"\b(prisma|knex|mongoose|sequelize)\b\s*[.(]|\.(findOne|findMany|findAll|insertOne|updateOne|deleteOne|aggregate)\s*\(|\bdb\.(query|collection|execute)\s*\(", "reads or writes a database"),
    (("java",), "database_io", r"\b(JdbcTemplate|EntityManager|PreparedStatement|ResultSet|DriverManager)\b|@(Query|Repository|Transactional)\b|\brepository\.\w+\s*\(|Repository\.(save|find|delete)\w*\s*\(", "reads or writes a database"),
    (("go",), "database_io", r"\bsql\.(Open|DB|Tx)\b|\.(QueryRow|Query|QueryContext|Exec|ExecContext|Prepare)\s*\(|\b(gorm|pgx|sqlx)\.\w+", "reads or writes a database"),
    (("rust",), "database_io", r"\b(sqlx|diesel|sea_orm|rusqlite|tokio_postgres)::|\.(fetch_one|fetch_all|fetch_optional|load::<)", "reads or writes a database"),
    (("csharp",), "database_io", r"\b(DbContext|SqlConnection|SqlCommand|IDbConnection|DbSet)\b|\.(SaveChanges(Async)?|FromSqlRaw|ExecuteReader|ExecuteNonQuery)\s*\(", "reads or writes a database"),
    (("kotlin",), "database_io", r"\b(JdbcTemplate|EntityManager|RoomDatabase)\b|@(Query|Dao|Insert|Transactional)\b|\b\w*[rR]epository\.\w+\s*\(", "reads or writes a database"),
    (("php",), "database_io", r"\bnew\s+PDO\b|\bDB::\w+|->(prepare|query|execute|fetchAll|save)\s*\(|\bmysqli_\w+\s*\(|::(where|find|create|all)\s*\(", "reads or writes a database"),
    (("ruby",), "database_io", r"\bActiveRecord\b|\.(where|find_by|find_each|create!?|update!?|save!?|destroy!?|pluck)\b|\bDB\[", "reads or writes a database"),
    # Files
    (("python",), "filesystem_io", r"(?<![.\w])open\s*\(|\.(read_text|write_text|read_bytes|write_bytes|unlink|mkdir|rglob|iterdir)\s*\(|\b(shutil|tempfile)\.\w+|\bos\.(remove|rename|makedirs|listdir|walk)\s*\(", "touches files"),
    (JS, "filesystem_io", r"\bfs(Promises)?\.\w+\s*\(|\b(readFile|writeFile|appendFile|createReadStream|createWriteStream)(Sync)?\s*\(", "touches files"),
    (("java",), "filesystem_io", r"\bFiles\.\w+\s*\(|\bnew\s+(File|FileReader|FileWriter|FileInputStream|FileOutputStream|RandomAccessFile)\b", "touches files"),
    (("go",), "filesystem_io", r"\bos\.(Open|Create|ReadFile|WriteFile|Remove|Mkdir|Rename|OpenFile)\w*\s*\(|\bioutil\.\w+\s*\(|\bfilepath\.Walk\w*", "touches files"),
    (("rust",), "filesystem_io", r"\bstd::fs\b|\bfs::\w+\s*\(|\bFile::(open|create)\b|\bOpenOptions\b", "touches files"),
    (("csharp",), "filesystem_io", r"\b(File|Directory)\.\w+\s*\(|\bnew\s+(FileStream|StreamReader|StreamWriter|FileInfo)\b", "touches files"),
    (("kotlin",), "filesystem_io", r"(?<![.\w])File\s*\(|\.(readText|writeText|readLines|appendText|bufferedReader)\s*\(|\bFiles\.\w+\s*\(", "touches files"),
    (("php",), "filesystem_io", r"\b(fopen|fwrite|fread|file_put_contents|file_get_contents|unlink|mkdir|scandir)\s*\(|\bStorage::\w+", "touches files"),
    (("ruby",), "filesystem_io", r"\b(File|Dir|FileUtils|IO)\.\w+", "touches files"),
    # Processes
    (("python",), "process_io", r"\bsubprocess\.\w+|\bos\.(system|popen|exec\w*|spawn\w*|kill)\s*\(", "starts or controls a process"),
    (JS, "process_io", r"\bchild_process\b|(?<![.\w])(exec|execFile|spawn|fork)(Sync)?\s*\(", "starts or controls a process"),
    (("java",), "process_io", r"\bProcessBuilder\b|\bRuntime\.getRuntime\(\)\.exec\b|@(Async|Scheduled)\b", "starts or controls a process"),
    (("go",), "process_io", r"\bexec\.Command\w*\s*\(|\bos\.StartProcess\s*\(", "starts or controls a process"),
    (("rust",), "process_io", r"\bCommand::new\s*\(|\bstd::process\b", "starts or controls a process"),
    (("csharp",), "process_io", r"\bProcess\.Start\s*\(|\bProcessStartInfo\b", "starts or controls a process"),
    (("php",), "process_io", r"\b(exec|shell_exec|system|passthru|proc_open|popen)\s*\(", "starts or controls a process"),
    (("ruby",), "process_io", r"`[^`]+`|\b(system|spawn)\s*[( ]['\"]|\bOpen3\.\w+|\bProcess\.\w+", "starts or controls a process"),
    # Concurrency
    (("python",), "concurrency", r"\b(threading|multiprocessing|asyncio|concurrent\.futures)\.\w+|\bawait\b|\basync\s+with\b|\bThreadPoolExecutor\b", "runs concurrently"),
    (JS, "concurrency", r"\bPromise\.(all|race|any|allSettled)\s*\(|\bnew\s+Worker\b|\bawait\b|\bsetInterval\s*\(", "runs concurrently"),
    (("java",), "concurrency", r"\b(CompletableFuture|ExecutorService|Executors|Thread|ReentrantLock|AtomicInteger|AtomicLong|ConcurrentHashMap)\b|\bsynchronized\b", "runs concurrently"),
    (("go",), "concurrency", r"\bgo\s+(func\b|\w+[.(])|\bsync\.\w+|\bmake\s*\(\s*chan\b|<-\s*\w+|\batomic\.\w+", "runs concurrently"),
    (("rust",), "concurrency", r"\btokio::(spawn|select|sync)|\bthread::spawn\b|\b(Mutex|RwLock|Arc|mpsc)\b|\.await\b", "runs concurrently"),
    (("csharp",), "concurrency", r"\bTask\.(Run|WhenAll|WhenAny)\b|\block\s*\(|\bSemaphoreSlim\b|\bInterlocked\.|\bCancellationToken\b|\bParallel\.", "runs concurrently"),
    (("kotlin",), "concurrency", r"\b(launch|async|withContext|runBlocking|coroutineScope)\b\s*[({]|\bsuspend\b|\bMutex\b|\bDispatchers\.", "runs concurrently"),
    (("php",), "concurrency", r"\bpcntl_fork\s*\(|\bdispatch\s*\(|\bAmp\\|\bnew\s+(Fiber|Thread)\b", "runs concurrently"),
    (("ruby",), "concurrency", r"\b(Thread|Ractor|Fiber|Mutex|Concurrent)\b|\.perform_(later|async)\b", "runs concurrently"),
    # State
    (("python",), "state_mutation", r"^\s*self\.\w+(\[[^\]]*\])?\s*[-+*/|&]?=(?!=)|^\s*global\s+\w+|\bsetattr\s*\(", "changes object state"),
    (JS, "state_mutation", r"\bthis\.\w+(\.\w+)*\s*[-+*/]?=(?!=)|\bset[A-Z]\w*\s*\(|\bdispatch\s*\(", "changes object state"),
    (("java",), "state_mutation", r"\bthis\.\w+\s*[-+*/]?=(?!=)", "changes object state"),
    (("go",), "state_mutation", r"^\s*[a-z]\w*\.\w+(\.\w+)*\s*[-+*/]?=(?!=)", "changes object state"),
    (("rust",), "state_mutation", r"\bself\.\w+(\.\w+)*\s*[-+*/]?=(?!=)|&mut\s+self\b", "changes object state"),
    (("csharp",), "state_mutation", r"^\s*_\w+\s*[-+*/]?=(?!=)|\bthis\.\w+\s*[-+*/]?=(?!=)", "changes object state"),
    (("php",), "state_mutation", r"\$this->\w+\s*[-+*/.]?=(?!=)|\$_SESSION\b", "changes object state"),
    (("ruby",), "state_mutation", r"@{1,2}\w+\s*(\|\||[-+*/])?=(?![=~])|\bsession\[", "changes object state"),
    # Input
    (("python",), "input_boundary", r"@\w*(app|router|api|blueprint|bp)\w*\.(route|get|post|put|delete|patch)\b|\brequest\.(args|form|json|data|GET|POST|body)\b|\binput\s*\(|\bsys\.argv\b|\bfrappe\.whitelist\b|\bform_dict\b", "takes input from outside"),
    (JS, "input_boundary", r"\b(app|router)\.(get|post|put|delete|patch|use)\s*\(|\breq\.(body|params|query|headers)\b|\bprocess\.(argv|stdin)\b|@(Get|Post|Put|Delete|Body|Param)\b", "takes input from outside"),
    (("java",), "input_boundary", r"@(Request|Get|Post|Put|Delete|Patch)Mapping\b|@(RequestBody|RequestParam|PathVariable|KafkaListener|RestController)\b|\bHttpServletRequest\b|\bScanner\s*\(\s*System\.in", "takes input from outside"),
    (("go",), "input_boundary", r"\bhttp\.(HandleFunc|Handle|Request)\b|\b\w+\.(GET|POST|PUT|DELETE|PATCH)\s*\(|\bos\.Args\b|\bflag\.(Parse|String|Int|Bool)\b|\b(ShouldBind|BindJSON|FormValue|QueryParam)\w*\s*\(", "takes input from outside"),
    (("rust",), "input_boundary", r"#\[(get|post|put|delete|patch)\s*\(|\b(Json|Query|Path|Form|State)<|\bstd::env::args\b|\bstdin\s*\(\)|\bRouter::new\b", "takes input from outside"),
    (("csharp",), "input_boundary", r"\[(Http(Get|Post|Put|Delete|Patch)|Route|ApiController|From(Body|Query|Route))\b|\bConsole\.ReadLine\s*\(|\bMap(Get|Post|Put|Delete)\s*\(", "takes input from outside"),
    (("kotlin",), "input_boundary", r"@(Request|Get|Post|Put|Delete|Patch)Mapping\b|@(RequestBody|RequestParam|PathVariable)\b|\bcall\.(receive|parameters)\b|\breadLine\s*\(|\b(get|post|put|delete)\s*\(\s*\"/", "takes input from outside"),
    (("php",), "input_boundary", r"\$_(GET|POST|REQUEST|FILES|SERVER)\b|\bRoute::\w+\s*\(|\$request->\w+|#\[Route\b|php://input", "takes input from outside"),
    (("ruby",), "input_boundary", r"\bparams\[|\bparams\.\w+|^\s*(get|post|put|delete|patch)\s+['\"]/|\bARGV\b|\bgets\b", "takes input from outside"),
    # Output
    (("python",), "output_boundary", r"(?<![.\w])print\s*\(|\b(logger|logging|log)\.(debug|info|warning|error|exception|critical)\s*\(|\b(jsonify|render|render_template|JSONResponse|HttpResponse|Response)\s*\(|\bsys\.stdout\b", "sends output"),
    (JS, "output_boundary", r"\bconsole\.\w+\s*\(|\bres\.(send|json|status|render|end)\s*\(|\bprocess\.stdout\b", "sends output"),
    (("java",), "output_boundary", r"\bSystem\.(out|err)\.|\b(log|logger|LOG|LOGGER)\.(debug|info|warn|error)\s*\(", "sends output"),
    (("java", "kotlin"), "output_boundary", r"\bResponseEntity\b", "names a response object"),
    (("go",), "output_boundary", r"\bfmt\.(Print|Fprint)\w*\s*\(|\blog\.\w+\s*\(|\bw\.Write\w*\s*\(|\b\w+\.(JSON|String|HTML)\s*\(\s*http\.", "sends output"),
    (("rust",), "output_boundary", r"\be?println!|\b(info|warn|error|debug|trace)!\s*\(|\bHttpResponse::", "sends output"),
    (("csharp",), "output_boundary", r"\bConsole\.Write\w*\s*\(|\b_?logger\.Log\w+\s*\(|\breturn\s+(Ok|BadRequest|NotFound|View|Json|Created\w*)\s*\(", "sends output"),
    (("kotlin",), "output_boundary", r"(?<![.\w])println?\s*\(|\b(log|logger)\.(debug|info|warn|error)\b|\bcall\.respond\w*\s*\(", "sends output"),
    (("php",), "output_boundary", r"^\s*(echo|print)\b|\bresponse\(\)|\bview\s*\(|\bLog::\w+|\berror_log\s*\(|\bnew\s+JsonResponse\b", "sends output"),
    (("ruby",), "output_boundary", r"\b(puts|render|redirect_to)\b|\blogger\.\w+", "sends output"),
    # Guards by declaration
    (("python",), "auth_guard", r"@\w*(login_required|permission_required|requires_auth|authenticated)\w*|\b(check_permission|has_permission|verify_token|authenticate)\s*\(", "checks rights"),
    (JS, "auth_guard", r"\b(requireAuth|isAuthenticated|authorize|verifyToken|passport\.authenticate)\b|\bjwt\.verify\s*\(|@UseGuards\b", "checks rights"),
    (("java",), "auth_guard", r"@(PreAuthorize|PostAuthorize|Secured|RolesAllowed)\b|\bSecurityContextHolder\b", "checks rights"),
    (("go",), "auth_guard", r"\b\w*(AuthMiddleware|RequireAuth|Authorize|VerifyToken|CheckPermission)\w*\s*\(|\bjwt\.Parse\w*\s*\(", "checks rights"),
    (("rust",), "auth_guard", r"\b(authorize|verify_token|require_auth|check_permission)\w*\s*[(!]|\bjsonwebtoken::", "checks rights"),
    (("csharp",), "auth_guard", r"\[Authorize\b|\bUser\.(IsInRole|HasClaim|Identity)\b|\bAuthorizeAsync\s*\(", "checks rights"),
    (("kotlin",), "auth_guard", r"@(PreAuthorize|Secured|RolesAllowed)\b|\bauthenticate\s*[({]", "checks rights"),
    (("php",), "auth_guard", r"\bAuth::\w+|\bGate::\w+|->(authorize|middleware)\s*\(|#\[IsGranted\b", "checks rights"),
    (("ruby",), "auth_guard", r"\b(authenticate_user!|authorize!?|current_user|before_action\s+:auth\w*)", "checks rights"),
    (("python",), "validation_guard", r"\b(BaseModel|Field|validator|field_validator|TypeAdapter)\b\s*\(|\.(is_valid|full_clean|validate)\s*\(|^\s*assert\s", "validates input"),
    (JS, "validation_guard", r"\b(z|yup|Joi)\.\w+\s*\(|\.(safeParse|validate|validateSync)\s*\(|@Is[A-Z]\w+\(", "validates input"),
    (("java",), "validation_guard", r"@(Valid|Validated|NotNull|NotBlank|NotEmpty|Size|Min|Max|Pattern)\b|\bObjects\.requireNonNull\s*\(|\bAssert\.\w+\s*\(", "validates input"),
    (("go",), "validation_guard", r"\bvalidate\.\w+\s*\(|`[^`]*\b(validate|binding):\"", "validates input"),
    (("rust",), "validation_guard", r"#\[validate\b|\.validate\s*\(\)|\bassert!?\s*\(|\bensure!\s*\(", "validates input"),
    (("csharp",), "validation_guard", r"\[(Required|StringLength|Range|RegularExpression|MaxLength)\b|\bModelState\.IsValid\b|\bArgumentNullException\b", "validates input"),
    (("kotlin",), "validation_guard", r"@(Valid|NotNull|NotBlank|Size|Min|Max)\b|\b(require|requireNotNull|check|checkNotNull)\s*\(", "validates input"),
    (("php",), "validation_guard", r"->validate\s*\(|\bValidator::make\s*\(|\bfilter_(var|input)\s*\(|#\[Assert\\", "validates input"),
    (("ruby",), "validation_guard", r"^\s*validates?\b|\.valid\?|\.require\(:\w+\)\.permit\b", "validates input"),
    # Caches
    (("python",), "caching", r"@(\w+\.)?(lru_cache|cache|cached_property|cached)\b|\b(cache|redis|memcache)\w*\.(get|set|delete|get_value|set_value)\s*\(", "uses a cache"),
    (JS, "caching", r"\b(cache|redis|memcached)\w*\.(get|set|del|has|put)\s*\(|\buseMemo\s*\(|\blocalStorage\.", "uses a cache"),
    (("java", "kotlin"), "caching", r"@(Cacheable|CacheEvict|CachePut)\b|\b(RedisTemplate|CacheManager|Caffeine)\b|\bcache\.(get|put|invalidate)\s*\(", "uses a cache"),
    (("go",), "caching", r"\b(cache|redis|rdb|memcache)\w*\.(Get|Set|Del|Add|New\w*)\s*\(", "uses a cache"),
    (("rust",), "caching", r"\b(cached|moka|redis)::|\bcache\.(get|insert|set)\s*\(|\b(lazy_static!|OnceCell|LazyLock|OnceLock)\b", "uses a cache"),
    (("csharp",), "caching", r"\bI?(MemoryCache|DistributedCache)\b|\b_?cache\.(Get|Set|TryGetValue|GetOrCreate)\w*\s*\(|\[ResponseCache\b", "uses a cache"),
    (("php",), "caching", r"\bCache::\w+|\b(apcu|memcached?)_\w+\s*\(|\bnew\s+(Redis|Memcached)\b|\bRedis::\w+", "uses a cache"),
    (("ruby",), "caching", r"\bRails\.cache\.\w+|\bRedis\.\w+|\bcache\.(fetch|read|write)\b", "uses a cache"),
    # Errors
    (("python",), "error_handling", r"^\s*(try\s*:|except\b|raise\b|finally\s*:)", "handles errors"),
    ((*JS, "java", "csharp", "kotlin", "php"), "error_handling", r"\btry\s*[{(]|\bcatch\s*[({]|\bthrow\s+|\bfinally\s*\{|\.catch\s*\(|\brunCatching\b", "handles errors"),
    (("go",), "error_handling", r"\bif\s+(\w+\s*:?=.*;\s*)?err\s*!=\s*nil\b|\berrors\.(New|Is|As|Wrap)\s*\(|\bfmt\.Errorf\s*\(|\bpanic\s*\(|\brecover\s*\(", "handles errors"),
    (("rust",), "error_handling", r"\.(unwrap|expect|unwrap_or\w*|map_err)\s*\(|\?\s*[;,)]|\bErr\s*\(|\bpanic!|\bbail!", "handles errors"),
    (("ruby",), "error_handling", r"^\s*(rescue|ensure|begin)\b|\braise\b", "handles errors"),
    # Configuration
    (("python",), "config_access", r"\bos\.(environ|getenv)\b|\bsettings\.[A-Z]\w+|\bconfigparser\b|\bfrappe\.conf\b", "reads configuration"),
    (JS, "config_access", r"\bprocess\.env\b|\bimport\.meta\.env\b|\bconfig\.get\s*\(", "reads configuration"),
    (("java", "kotlin"), "config_access", r"@(Value|ConfigurationProperties)\b|\bSystem\.(getenv|getProperty)\s*\(|\benvironment\.getProperty\s*\(", "reads configuration"),
    (("go",), "config_access", r"\bos\.(Getenv|LookupEnv)\s*\(|\bviper\.\w+\s*\(", "reads configuration"),
    (("rust",), "config_access", r"\b(std::)?env::var\b|\bConfig::(builder|from|new)\b|\bdotenv", "reads configuration"),
    (("csharp",), "config_access", r"\bEnvironment\.GetEnvironmentVariable\s*\(|\bIConfiguration\b|\b_?config(uration)?\[|\bIOptions<", "reads configuration"),
    (("php",), "config_access", r"\bgetenv\s*\(|\benv\s*\(|\bconfig\s*\(|\$_ENV\b", "reads configuration"),
    (("ruby",), "config_access", r"\bENV\[|\bENV\.fetch\b|\bRails\.(configuration|application\.config)\b", "reads configuration"),
    # Wire formats
    (("python",), "deserialization", r"\b(json|yaml|pickle|toml|tomllib|marshal)\.(loads?|safe_load)\s*\(|\.(model_validate|parse_obj|from_json)\w*\s*\(", "parses data"),
    (("python",), "serialization", r"\b(json|yaml|pickle|toml)\.(dumps?|safe_dump)\s*\(|\.(model_dump|to_json|to_dict|as_dict)\w*\s*\(", "writes data"),
    (JS, "deserialization", r"\bJSON\.parse\s*\(|\.json\s*\(\s*\)|\bparse(Int|Float)\s*\(", "parses data"),
    (JS, "serialization", r"\bJSON\.stringify\s*\(|\bserialize\w*\s*\(", "writes data"),
    (("java", "kotlin"), "deserialization", r"\.(readValue|fromJson|readTree|readObject|decodeFromString)\s*[(<]", "parses data"),
    (("java", "kotlin"), "serialization", r"\.(writeValue\w*|toJson|writeObject|encodeToString)\s*\(", "writes data"),
    (("go",), "deserialization", r"\b(json|xml|yaml|proto)\.(Unmarshal|NewDecoder)\w*\s*\(", "parses data"),
    (("go",), "serialization", r"\b(json|xml|yaml|proto)\.(Marshal|NewEncoder)\w*\s*\(", "writes data"),
    (("rust",), "deserialization", r"\bserde_\w+::from_\w+|\bDeserialize\b|\.parse::<", "parses data"),
    (("rust",), "serialization", r"\bserde_\w+::to_\w+|\bSerialize\b|\.to_string\s*\(\)", "writes data"),
    (("csharp",), "deserialization", r"\b(JsonSerializer|JsonConvert)\.Deserialize\w*", "parses data"),
    (("csharp",), "serialization", r"\b(JsonSerializer|JsonConvert)\.Serialize\w*", "writes data"),
    (("php",), "deserialization", r"\b(json_decode|unserialize|simplexml_load_string)\s*\(", "parses data"),
    (("php",), "serialization", r"\b(json_encode|serialize)\s*\(|->toArray\s*\(|->toJson\s*\(", "writes data"),
    (("ruby",), "deserialization", r"\bJSON\.parse\b|\bYAML\.(safe_)?load\w*|\bMarshal\.load\b", "parses data"),
    (("ruby",), "serialization", r"\.to_json\b|\bJSON\.(generate|dump)\b|\bYAML\.dump\b|\bMarshal\.dump\b", "writes data"),
    # Time and chance
    (("python",), "time_or_randomness", r"\b(datetime|date)\.(now|utcnow|today)\s*\(|\btime\.(time|sleep|monotonic)\s*\(|\b(random|secrets|uuid)\.\w+\s*\(", "depends on time or chance"),
    (JS, "time_or_randomness", r"\bDate\.now\s*\(|\bnew\s+Date\s*\(\s*\)|\bMath\.random\s*\(|\bsetTimeout\s*\(|\brandomUUID\s*\(", "depends on time or chance"),
    (("java", "kotlin"), "time_or_randomness", r"\b(Instant|LocalDate|LocalDateTime|ZonedDateTime|Clock)\.\w*[nN]ow\b|\bSystem\.(currentTimeMillis|nanoTime)\s*\(|\bnew\s+Random\b|\bUUID\.randomUUID\b|\bRandom\.next", "depends on time or chance"),
    (("go",), "time_or_randomness", r"\btime\.(Now|Since|Sleep|After|Tick)\b|\brand\.\w+|\buuid\.New", "depends on time or chance"),
    (("rust",), "time_or_randomness", r"\b(Instant|SystemTime|Utc|Local)::now\b|\brand::|\bUuid::new", "depends on time or chance"),
    (("csharp",), "time_or_randomness", r"\bDateTime(Offset)?\.(Now|UtcNow|Today)\b|\bnew\s+Random\b|\bGuid\.NewGuid\b|\bStopwatch\b", "depends on time or chance"),
    (("php",), "time_or_randomness", r"\b(time|microtime|date|rand|mt_rand|random_int|uniqid)\s*\(|\bCarbon::now\b|\bnow\s*\(\)", "depends on time or chance"),
    (("ruby",), "time_or_randomness", r"\b(Time|Date|DateTime)\.(now|current|today)\b|\b(rand|SecureRandom|Random)\b", "depends on time or chance"),
    # Loading by a name in a string
    (("python",), "orm_dynamic_load", r"\bfrappe\.(get_doc|get_all|get_list|new_doc|get_value)\s*\(\s*['\"]|\bapps\.get_model\s*\(", "loads a model by name"),
]
