"""Names, prefixes and labels that results must reproduce."""

# ---------------------------------------------------------------------------
# File extension -> MIME type.
# ---------------------------------------------------------------------------
EXTENSION_MIME = {
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".xml": "text/xml",
    ".html": "text/html",
    ".htm": "text/html",
    ".json": "application/json",
    ".yaml": "application/yaml",
    ".yml": "application/yaml",
    ".md": "text/markdown",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".zip": "application/zip",
    ".rar": "application/x-rar",
    ".7z": "application/x-7z-compressed",
    ".tar": "application/x-tar",
    ".gz": "application/gzip",
    ".bz2": "application/x-bzip2",
    ".pdf": "application/pdf",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".bmp": "image/bmp",
    ".svg": "image/svg+xml",
    ".webp": "image/webp",
    ".mp3": "audio/mpeg",
    ".mp4": "video/mp4",
    ".avi": "video/x-msvideo",
    ".mov": "video/quicktime",
    ".wav": "audio/wav",
    ".bin": "application/octet-stream",
    ".exe": "application/x-msdownload",
    ".dll": "application/x-msdownload",
    ".rtf": "application/rtf",
    ".dot": "application/msword",
    ".pps": "application/vnd.ms-powerpoint",
    ".xlt": "application/vnd.ms-excel",
}

OCTET = "application/octet-stream"
DOCX = EXTENSION_MIME[".docx"]
XLSX = EXTENSION_MIME[".xlsx"]
PPTX = EXTENSION_MIME[".pptx"]
DOC = "application/msword"
XLS = "application/vnd.ms-excel"
PPT = "application/vnd.ms-powerpoint"
ZIP = "application/zip"
OLE = "application/x-ole-storage"

# ---------------------------------------------------------------------------
# What a scan passes over.
# ---------------------------------------------------------------------------
SKIP_EXTENSIONS = [
    ".dwg", ".mp3", ".wav", ".mp4", ".avi", ".mkv", ".flv", ".mov",
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp",
    ".exe", ".dll", ".so", ".class", ".pyc", ".pyd", ".wasm",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
]
SKIP_MIMES = [
    "image/vnd.dwg",
    "application/octet-stream",
    "application/x-msdownload",
    "application/font-sfnt",
    "font/ttf",
    "font/otf",
    "font/woff",
    "font/woff2",
    "text/css",
    "application/encrypted",
    "text/javascript",
    "image/jpeg",
    "image/png",
    "image/gif",
    "image/bmp",
    "image/webp",
    "image/svg+xml",
    "audio/mpeg",
    "audio/wav",
    "video/mp4",
    "video/x-msvideo",
    "video/quicktime",
]
SKIP_MIME_PREFIXES = ["font/", "image/", "audio/", "video/"]
UNSUPPORTED_PREFIXES = [
    "application/x-msdownload",
    "application/x-executable",
    "application/x-dosexec",
    "application/x-sharedlib",
    "image/jpeg",
    "image/png",
    "image/gif",
    "image/bmp",
    "image/tiff",
    "audio/",
    "video/",
    "application/octet-stream",
]
INTERNAL_STREAM_PATTERN = (
    r"^\[\d+\].+|^~\$|^__SRP_\d+$|^__substg1\.0_|^__attach_version1\.0_"
    r"|^__properties_version1\.0$|^MsoDataStore|Thumbs\.db$|\.tmp$"
)

# ---------------------------------------------------------------------------
# Ordered header signatures (upper-case hex prefix, label).
# Where a prefix repeats, it keeps its first place and takes its last label.
# ---------------------------------------------------------------------------
SIGNATURES = [
    ("504B0304", "ZIP格式 (可能是Office文档/APK/JAR等)"),
    ("D0CF11E0A1B11AE1", "Microsoft复合文档二进制格式 (DOC/XLS/PPT等)"),
    ("FFD8FF", "JPEG图像"),
    ("89504E470D0A1A0A", "PNG图像"),
    ("47494638", "GIF图像"),
    ("424D", "BMP图像"),
    ("49492A00", "TIFF图像 (小端)"),
    ("4D4D002A", "TIFF图像 (大端)"),
    ("52494646", "WEBP/WAV/AVI (RIFF格式)"),
    ("38425053", "Photoshop文档 (PSD)"),
    ("494433", "MP3音频 (ID3标签)"),
    ("FFFB", "MP3音频"),
    ("FFF3", "MP3音频"),
    ("FFF2", "MP3音频"),
    ("664C6143", "FLAC音频"),
    ("52494646", "WAV音频 (RIFF标记)"),
    ("4F676753", "OGG音频/视频"),
    ("1A45DFA3", "Matroska视频 (MKV)"),
    ("000001BA", "MPEG传输流 (TS/MTS)"),
    ("000001B3", "MPEG视频 (MPG/MPEG)"),
    ("6674797069736F6D", "MP4视频"),
    ("4654595049534F4D", "MP4视频"),
    ("52494646", "AVI视频 (RIFF标记)"),
    ("3026B2758E66CF11", "ASF/WMV/WMA"),
    ("464C5601", "FLV视频"),
    ("504B0304", "ZIP压缩包"),
    ("526172211A0700", "RAR压缩包 (v1.5+)"),
    ("526172211A070100", "RAR压缩包 (v5.0+)"),
    ("377ABCAF271C", "RAR压缩包 (旧版本)"),
    ("1F8B08", "GZIP压缩包"),
    ("1F9D", "COMPRESS压缩数据"),
    ("425A68", "BZIP2压缩包"),
    ("FD377A585A00", "XZ压缩包"),
    ("04224D18", "7-ZIP压缩包"),
    ("213C617263683E0A", "DEB安装包"),
    ("4D5A", "Windows可执行文件 (EXE/DLL/OCX)"),
    ("7F454C46", "ELF可执行文件 (Linux/Unix)"),
    ("CAFEBABE", "Java类文件/Mach-O Fat文件"),
    ("FEEDFACE", "Mach-O (32位)"),
    ("FEEDFACF", "Mach-O (64位)"),
    ("CEFAEDFE", "Mach-O (逆序, 32位)"),
    ("CFFAEDFE", "Mach-O (逆序, 64位)"),
    ("DEY\x01", "DEX (Dalvik可执行文件, Android)"),
    ("FEEDFEED", "JKS Java密钥存储"),
    ("53514C69746520666F726D6174203300", "SQLite数据库"),
    ("4D7953514C", "MySQL数据库"),
    ("1F8B08", "GZ数据库备份"),
    ("5249464644", "Webm格式"),
    ("25504446", "PDF文档"),
    ("7B5C72746631", "RTF文档"),
    ("0A2524454E44", "UNIX mailbox"),
    ("4F54544F", "OpenType字体"),
    ("00010000", "TrueType字体"),
    ("774F4646", "WOFF字体"),
    ("774F4632", "WOFF2字体"),
    ("4C000000011402", "Windows链接文件 (LNK)"),
    ("49536328", "Windows安装程序包 (CAB)"),
    ("0000000C6A502020", "JPEG2000图像"),
    ("EDABEEDB", "RPM包管理器包"),
    ("53494D504C4520", "FITS科学图像格式"),
    ("414331303031", "GPG/PGP加密文件"),
    ("3C3F786D6C", "XML文件"),
    ("3C68746D6C", "HTML文件"),
    ("3C21444F43", "HTML文件 (带DOCTYPE)"),
    ("255044462D", "PDF文档 (带版本)"),
    ("2321", "Shell脚本"),
    ("7061636B", "Python已编译代码"),
    ("4C01", "ELF文件对象"),
    ("EFBBBF", "UTF-8带BOM文本"),
    ("FEFF", "UTF-16 (BE)带BOM文本"),
    ("FFFE", "UTF-16 (LE)带BOM文本"),
    ("FFFE0000", "UTF-32 (LE)带BOM文本"),
    ("0000FEFF", "UTF-32 (BE)带BOM文本"),
    ("4B444D", "VMDK虚拟机磁盘"),
    ("7F454C46", "ELF可执行文件"),
    ("23204469736B2044", "VDI虚拟机磁盘"),
    ("636F6E6563746978", "VHD虚拟机磁盘"),
    ("213C617263683E", "Linux ar归档"),
    ("52656365697665", "BitTorrent部分下载"),
]

# ---------------------------------------------------------------------------
# Labels used when only the extension is known.
# ---------------------------------------------------------------------------
EXTENSION_LABELS = {
    ".txt": "文本文件",
    ".log": "日志文件",
    ".ini": "配置文件",
    ".conf": "配置文件",
    ".cfg": "配置文件",
    ".csv": "CSV数据文件",
    ".json": "JSON数据文件",
    ".xml": "XML数据文件",
    ".html": "HTML文件",
    ".htm": "HTML文件",
    ".css": "CSS样式表",
    ".js": "JavaScript文件",
    ".py": "Python源代码",
    ".java": "Java源代码",
    ".c": "C源代码",
    ".cpp": "C++源代码",
    ".h": "C/C++头文件",
    ".sh": "Shell脚本",
    ".bat": "Windows批处理文件",
    ".ps1": "PowerShell脚本",
    ".sql": "SQL脚本",
    ".md": "Markdown文档",
    ".rst": "reStructuredText文档",
    ".yaml": "YAML数据文件",
    ".yml": "YAML数据文件",
    ".toml": "TOML配置文件",
    ".db": "数据库文件",
    ".sqlite": "SQLite数据库",
    ".mp3": "MP3音频",
    ".mp4": "MP4视频",
    ".avi": "AVI视频",
    ".mov": "QuickTime视频",
    ".mkv": "Matroska视频",
    ".jpg": "JPEG图像",
    ".jpeg": "JPEG图像",
    ".png": "PNG图像",
    ".gif": "GIF图像",
    ".bmp": "BMP图像",
    ".tif": "TIFF图像",
    ".tiff": "TIFF图像",
    ".webp": "WebP图像",
    ".pdf": "PDF文档",
    ".doc": "Word文档",
    ".docx": "Word文档",
    ".xls": "Excel电子表格",
    ".xlsx": "Excel电子表格",
    ".ppt": "PowerPoint演示文稿",
    ".pptx": "PowerPoint演示文稿",
    ".zip": "ZIP压缩包",
    ".rar": "RAR压缩包",
    ".7z": "7-Zip压缩包",
    ".tar": "TAR归档",
    ".gz": "GZIP压缩包",
    ".bz2": "BZIP2压缩包",
}
OFFICE_TYPE_WORDS = ["Word", "Excel", "PowerPoint", "Office", ".doc", ".xls", ".ppt"]

# ---------------------------------------------------------------------------
# OLE subtype by extension and by marker text (first 16 KB).
# ---------------------------------------------------------------------------
OLE_EXTENSIONS_STRICT = {".doc": DOC, ".xls": XLS, ".ppt": PPT}
OLE_EXTENSIONS_WIDE = {
    ".doc": DOC, ".docx": DOC, ".rtf": DOC, ".dot": DOC,
    ".xls": XLS, ".xlsx": XLS, ".xlt": XLS, ".xlm": XLS,
    ".ppt": PPT, ".pptx": PPT, ".pps": PPT,
}
OLE_WIDE_MARKERS = [
    (PPT, ["PowerPoint Document", "PP97_DUALSTORAGE", "Current User",
           "SlideListWithText", "Pictures", "SlidePersist"]),
    (XLS, ["Workbook", "Excel", "Worksheet", "Microsoft Excel", "Sheet",
           "PivotTable", "PivotCache"]),
    (DOC, ["Word.Document", "MSWordDoc", "Microsoft Word", "Normal.dot",
           "WordDocument", "Document Summary"]),
]

# ---------------------------------------------------------------------------
# OLE scoring (hex byte markers).
# ---------------------------------------------------------------------------
OLE_SCORE_LABELS = {
    "word": "Microsoft Word文档 (.doc)",
    "excel": "Microsoft Excel工作簿 (.xls)",
    "ppt": "Microsoft PowerPoint演示文稿 (.ppt)",
}
OLE_SCORE_MARKERS = {
    "word": ["57006F007200640044006F006300", "57006F00720064002E0044006F006300",
             "4D53576F7264446F63", "426A447770"],
    "excel": ["57006F0072006B0062006F006F006B00", "45007800630065006C00",
              "42004900460046", "5368656574", "E57A311C"],
    "ppt": ["50006F0077006500720050006F0069006E007400",
            "50524553454E544154494F4E", "50503031", "536C696465"],
}
OLE_SCORE_PATTERNS = {
    "word": ["ECA5C100", "426F6F6B6D61726B"],
    "excel": ["0908100000060500", "FDFFFFFF10"],
    "ppt": ["A0461DF0", "006E2800"],
}
# (marker at the start of the sector, marker anywhere in the sector)
OLE_SECTOR_MARKS = {
    "excel": (["0908"], ["FDFF0000"]),
    "word": (["DC00"], ["ECA5C100"]),
    "ppt": ([], ["006E2800", "0F000000AF"]),
}
# (byte, more than this many times) pairs over the first 4 KB
OLE_BYTE_COUNTS = {
    "word": [(0x57, 30), (0x6F, 30)],
    "excel": [(0x45, 30), (0x78, 30)],
    "ppt": [(0x50, 30), (0x53, 20)],
}
OLE_UNKNOWN_LABEL = "Microsoft Office二进制文档 (无法确定具体类型)"

# ---------------------------------------------------------------------------
# Office guess by marker counts (first 32 KB).
# ---------------------------------------------------------------------------
OFFICE_GATE_WORDS = ["Microsoft", "Office", "Document", "Workbook",
                     "PowerPoint", "Excel", "Word", "Worksheet"]
OFFICE_COUNT_WORDS = {
    "doc": ["Word", "Document", "DocFile", "MSWordDoc", ".docx", ".doc",
            "w:document", "word/document.xml", "wordDocument"],
    "xls": ["Excel", "Workbook", "Worksheet", "spreadsheet", ".xlsx", ".xls",
            "xl/workbook.xml", "xl:workbook", "sst", "Sheet", "x:sheet"],
    "ppt": ["PowerPoint", "Presentation", "Slide", ".pptx", ".ppt",
            "ppt/presentation.xml", "p:presentation", "slideshow"],
}
OFFICE_GUESS_LABELS = {
    "doc": ("word/document.xml",
            "可能是Microsoft Word文档 (.docx) [基于内容特征判断]",
            "可能是Microsoft Word文档 (.doc) [基于内容特征判断]"),
    "xls": ("xl/workbook.xml",
            "可能是Microsoft Excel工作簿 (.xlsx) [基于内容特征判断]",
            "可能是Microsoft Excel工作簿 (.xls) [基于内容特征判断]"),
    "ppt": ("ppt/presentation.xml",
            "可能是Microsoft PowerPoint演示文稿 (.pptx) [基于内容特征判断]",
            "可能是Microsoft PowerPoint演示文稿 (.ppt) [基于内容特征判断]"),
}
OFFICE_GUESS_UNKNOWN = "可能是Office文档 (具体类型未知) [基于内容特征判断]"

ENCRYPTION_HEADER_MARKS = ["8CBAD9FF0ADA", "52617221"]
ENCRYPTION_NAMES = ["EncryptedPackage", "EncryptionInfo"]

# ---------------------------------------------------------------------------
# Archive members read as text.
# ---------------------------------------------------------------------------
ARCHIVE_TEXT_EXTENSIONS = [
    ".txt", ".md", ".csv", ".json", ".xml", ".html", ".htm", ".yaml",
    ".yml", ".cfg", ".ini", ".conf", ".log", ".properties", ".sql",
    ".js", ".py", ".java", ".c", ".cpp", ".h", ".cs", ".php", ".rb",
]
ARCHIVE_JUNK_PREFIXES = ["._", "__MACOSX"]

# ---------------------------------------------------------------------------
# Notices, statuses and report texts.
# ---------------------------------------------------------------------------
NOTICE_FILE_CUT = "\n\n[注意: 文件过大，内容已截断]"
NOTICE_CONTENT_CUT = "\n\n[注意: 内容过长，已截断]"
NOTICE_REPORT_CUT = "\n[内容已截断...]"
STATUS_FAILED = "失败"
STATUS_EMPTY = "空文件"
STATUS_SKIPPED = "已跳过"
STATUS_OK = "成功"
TYPE_SENSITIVE = "敏感"
TYPE_REGULAR = "常规"
MODEL_MARKER = "BERT模型检测为敏感内容"
LABEL_STRUCTURED = "结构化模式"
LABEL_NUMBER = "数字模式"
EXTRACTION_ERRORS = ["提取失败", "不支持的文件类型"]
CLEAN_ERRORS = ["Unsupported file type", "Text extraction failed"]
UNKNOWN_PREFIX = "未知"
CSV_DELIMITERS = [",", ";", "\t", "|"]

# Encodings in the order they are tried on binary content.
TEXT_ENCODINGS = ["utf-8", "latin1", "cp1252", "gb18030", "big5", "utf-16", "utf-16-le", "utf-16-be"]
