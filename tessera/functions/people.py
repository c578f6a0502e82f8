"""Chinese person and company names: whole-value test, and search in text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import trim

# Surnames, words that are no names, and words and prefixes of text search. They must equal the reference's.
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹"
    "喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐费廉岑薛雷贺倪"
    "汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹"
    "狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童"
    "颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫经房裘缪干解应宗丁"
    "宣贲邓郁单杭洪包诸左石崔吉钮龚党刘姬欧司"
)
COMPOUND_SURNAMES = "欧阳 司马 上官 诸葛 夏侯 东方 皇甫 尉迟 公孙 慕容 司徒 司空 西门 南宫 端木 轩辕 令狐 独孤 宇文 长孙 呼延 闻人".split()
NOT_NAMES = (
    "一队 万元 主体 俱乐部 债务类别 入职时间 关联关系 其他 其他费用 分析师 原币单位 变更类型 合计 后期 品牌主管 "
    "品牌策划 商务总监 商务经理 备注 奖金分成 姓名 实习生 平面设计 应付账款 总人数 序号 岗位 应发 实发 扣款 "
    "社保 公积金 个税 实付 应收 应付 账款 工资 薪酬 金额 费用 类型 说明 名称 单位 时期 期间 摘要 "
    "项目 科目 凭证 日期 时间 人员 部门 职务 级别 总计 小计 大写 人民币 银行 账号 账户 审核 "
    "制表 复核 批准 录入 提交 状态 进度 类别 来源"
).split()
PERSON_PREFIXES = "申请人 审批人 经理 姓名 负责人 经办人 联系人 客户经理".split()
COMPANY_PREFIXES = "供应商 公司 企业 客户公司 合作方 厂商 甲方 乙方".split()
KNOWN_NAMES = ["张伟", "李娜", "王芳", "刘洋", "陈静", "杨帆", "赵磊", "黄敏", "周杰", "吴霞", "Alice Chen", "Bob Liu", "Carol Wang", "David Zhang", "Eva Li"]
KNOWN_COMPANIES = ["亚玛芬体育", "小菜园集团", "MayAir", "Joy IPO", "Acme Inc", "GlobalTech", "阿里巴巴", "腾讯", "华为", "字节跳动", "工商银行", "中国移动"]
NAME_COLUMNS = ("name", "姓名", "employee_name", "user_name", "人员")

HAN = "一-鿿"
GAP = r"[\s\x1c-\x1f]*[：:][\s\x1c-\x1f]*"
PERSON_AFTER = rf"(?U)(?:{'|'.join(PERSON_PREFIXES)}){GAP}([{HAN}]{{2,4}})"
COMPANY_AFTER = rf"(?U)(?:{'|'.join(COMPANY_PREFIXES)}){GAP}([{HAN}A-Za-z0-9&.,·\-\s\x1c-\x1f]{{2,30}})"


def is_person_name(v: Column) -> Column:
    """Two to four Han characters, no listed word, beginning with a surname."""
    return v.rlike(rf"\A[{HAN}]{{2,4}}\z") & ~v.isin(NOT_NAMES) & (F.left(v, F.lit(2)).isin(COMPOUND_SURNAMES) | F.left(v, F.lit(1)).isin(list(SURNAMES)))


def by_length(words: Iterable[str]) -> list[str]:
    """Longest first, then by code point: the order in which words are looked for."""
    return sorted(set(words), key=lambda w: (-len(w), w))


def quoted(word: str) -> str:
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


def person_names(text: Column, people: Iterable[str] | None = None) -> Column:
    """Names after a prefix in order, then known names that no Han character touches, then listed names anywhere."""
    known = F.array(*(F.when(text.rlike(rf"(?<![{HAN}]){quoted(w)}(?![{HAN}])"), F.lit(w)) for w in by_length(KNOWN_NAMES)))
    own = by_length({p for p in people or () if p} - set(KNOWN_NAMES))
    found = F.concat(F.regexp_extract_all(text, F.lit(PERSON_AFTER), F.lit(1)), known)
    if own:
        found = F.concat(found, F.filter(F.array(*map(F.lit, own)), lambda w: F.contains(text, w)))
    return F.array_distinct(F.filter(found, lambda w: w.isNotNull() & (w != "")))


def company_names(text: Column) -> Column:
    after = F.transform(F.regexp_extract_all(text, F.lit(COMPANY_AFTER), F.lit(1)), trim)
    known = F.filter(F.array(*map(F.lit, by_length(KNOWN_COMPANIES))), lambda w: F.contains(text, w))
    return F.array_distinct(F.filter(F.concat(after, known), lambda w: w != ""))
