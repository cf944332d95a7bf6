"""Word lists and patterns that results must agree with."""

# Queries that ask for overviews.
BROAD_QUERIES = [
    "相关的.*文档有哪些", "有哪些.*项目", "包含.*的文档", "涉及.*的项目", "哪些.*文档", "哪些.*项目", "有.*多少.*文档", "有.*多少.*项目",
]

# Texts that follow up on the turn before.
FOLLOW_UPS = [
    "^那(?:么|这个|第二个|第三个|第一个|它|他|她|这些)", "^(?:详细|具体|展开)(?:说说|讲讲|解释)", "^(?:能|可以|能否)(?:详细|具体|展开)", "^(?:还有|另外)(?:呢|吗)",
    "^(?:然后|接下来)(?:呢|怎么样)", "^(?:这|那)(?:是|个)(?:什么|为什么|怎么)", "^(?:上面|前面|刚才|之前)(?:的|提到)", "^(?:它|他|她)(?:们|的)?(?:和|跟|与|比)",
    "^(?:再|继续|接着)(?:说|讲|解释)", "^(?:什么意思|为什么)",
]

# Document types that a filter may name.
DOC_TYPES = ["客户项目验收", "技术方案", "技术架构设计", "来往账目", "系统测试报告", "需求规格说明书", "项目人员清单", "项目管理计划", "项目费用结算", "项目进度汇报", "大型台账"]

# Stop words, and punctuation that counts as such.
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着",
    "没有", "看", "好", "自己", "这", "他", "她", "它", "们", "那", "被", "从", "把", "对", "让", "给", "跟", "向", "往", "为",
    "可以", "可能", "需要", "应该", "能够", "已经", "正在", "将要", "这个", "那个", "这些", "那些", "什么", "怎么", "为什么", "多少",
    "如果", "因为", "所以", "但是", "而且", "或者", "虽然", "不过", "比较", "非常", "特别", "尤其", "几乎", "大概", "大约", "左右",
    "以及", "等等", "之类", "通过", "进行", "使用", "采用", "利用", "基于", "根据", "按照", "关于", "对于", "作为", "其中", "其中的",
    "方面", "方式", "情况", "问题", "系统", "功能", "模块", "部分", "该", "其", "此", "之", "且", "则", "而", "与", "或", "及",
    "用", "做", "来", "得", "能", "可", "于",
    " ", "\t", "\n", "，", "。", "！", "？", "、", "；", "：", "“", "”", "‘", "’", "（", "）", "【", "】", "《", "》", "—", "…", "·", "～", "￥",
]

# Entity categories by name.
CLIENTS = [
    "万科集团", "中信证券", "中化集团", "中国中车", "中国中铁", "中国建筑", "中国电科", "中国石油", "中国移动", "中国联通", "中国航发", "中国航天", "中国船舶", "中国银行",
    "中粮集团", "中钢集团", "华润置地", "华能集团", "南方电网", "国家电网", "国泰君安", "太平洋保险", "宝武钢铁", "招商银行", "浦发银行", "碧桂园", "融创中国", "龙湖集团",
]
TECHNOLOGY = [
    "Redis", "MySQL", "PostgreSQL", "MongoDB", "Kafka", "RabbitMQ", "RocketMQ", "Elasticsearch", "Nginx", "Docker", "Kubernetes", "Jenkins", "GitLab",
    "Spring", "SpringCloud", "Vue", "React", "Node.js", "Python", "Java", "阿里云", "腾讯云", "华为云", "AWS", "Azure", "高斯DB", "MinIO",
]
DEPARTMENTS = ["产品设计部", "人力资源部", "商务拓展部", "技术研发部", "财务管理部", "质量保障部", "项目管理部"]

# Names of enterprises.
ENTERPRISE = (
    "集团|公司|银行|证券|电力|保险|能源|通信|钢铁|船舶|置地|宝武|中车|中化|中钢|招商局|华润|中信|浦发|招商|万科|中粮|南方电网|国家电网|中国移动|中国联通|"
    "中国电信|中国银行|建设银行|农业银行|工商银行|交通银行|国泰君安|华泰|光大|民生|平安|太平洋|新华|人寿"
)
