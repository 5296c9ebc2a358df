"""Personal information in free text: finding it, and keyed surrogates in its place."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleylake.runtime import materialise

# Common Chinese surnames of one and of two characters.
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
    "常温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆蓝路游辛靳管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤阳时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑景党宫费卜冷晏席卫"
)
COMPOUND = "欧阳|太史|端木|上官|司马|东方|独孤|南宫|万俟|闻人|夏侯|诸葛|尉迟|公羊|赫连|澹台|皇甫|宗政|濮阳|公冶|太叔|申屠|公孙|慕容|仲孙|钟离|长孙|宇文|司徒|鲜于|司空|闾丘|令狐|百里|呼延|西门|南门|轩辕"
# Common words that begin like a surname, and titles that make a surname no full name.
WORDS = (
    "程序|程度|方案|方便|方法|方向|白板|白天|白色|金额|金融|车票|车站|车辆|周末|周[一二三四五六日天]|周报|周年|马上|马路|明[天早晚日]|单号|单元|单位|单子|安全|安排|安装|齐全|时间|时候|高铁|高兴|高速|路上|路由|路口|路费|路边|辛苦|石头|江边|"
    "于是|任务|何时|何必|常常|常用|温度|文件|文字|文档|牛奶|成功|成员|成本|连接|连续|简单|项目|包裹|包装|管理员?|游戏|解决|解释|阳台|季度|关于|关闭|关系|万一|严重|武器|毛病|田地|许多|谢谢|钱包|左右|费用|"
    "舒服|符合|尚未|宁可|申请|章节|康复|施工|黎明|夏天|范围|陆续|钟头|余额|余下|罗列|胡同|胡说|黄色|陈列|陈旧|张贴|房东|房间|房子|房客|柴油|路人|车主|项链|计划|史料|雷雨|龙头|安静|白鹭|石榴|麦芽|白糖|苗头"
)
STOP = re.compile(WORDS)
TITLES = "老师|师傅|先生|女士|小姐|同学|经理|主任|老板|阿姨|叔叔|大爷|医生|教授|总|哥|姐"
TITLED = re.compile(rf".{{1,2}}(?:{TITLES})")
HAN = "一-鿿"

# Characters common in given names, and characters that rarely stand in one because they build sentences.
GIVEN = set(
    "伟芳娜秀敏静丽强磊军洋勇艳杰娟涛超兰霞平刚桂英华玉萍红娥玲芬梅燕彬凤洁琳云莲雪荣妹香月瑞佳嘉琼珍莉璐娅琦晶妍倩婷婉颖露瑶怡雁蓉眉君琴薇菁梦岚韵艺咏聪澜纯悦昭冰琬羽希宁欣筠竹凝晓欢枫芸菲亚宜舒影荔枝思"
    "国建志文子浩宇轩博涵辰梓晨俊鹏辉飞龙斌波健森峰海江天福生东新民永世昌宏豪坤鑫旭阳光明义仁良庆振海雄斯立刘翔星初长远安若清林立雅诗静慧智奇岩松柏泽润瑜然毅远恒景语桐秋亦尧墨澈儿书沐奕宸彤凌"
)
PLAIN = set("的了是在不我你他她它们这那有没也都就还要会能很太吗吧呢啊把被给让对从去上下里外前后多少几个只件份张次年日号点分元什么怎哪谁其此且但而或因为所以如果可与和跟同向到来说看问做用打发送收买卖吃喝走跑坐站开关写读再又才刚已正将每各该应必须需先后再最更非等今昨")
SURE_SURNAME = set("王李张刘陈杨赵吴徐孙朱胡郭何林罗郑梁谢宋唐许韩冯邓曹彭曾肖董袁潘蒋蔡余杜苏魏吕丁沈姚卢姜崔钟谭陆汪廖贾韦邹孟熊秦邱尹薛闫侯陶贺顾郝龚邵覃欧")
HEAD = re.compile(rf"{COMPOUND}|[{SURNAMES}]")
# What stands before a name: labels, and verbs, relations and prepositions that take a person.
LABEL = re.compile(r"(?:收件人|收货人|寄件人|联系人|经办人|报名人?|负责人|姓名|名字|抬头(?:个人)?|乘客|患者|户名|作者|签名|签收|名叫|我叫|叫做|署名|申请人|委托人|法人|代表|@|—)[：: 　]{0,2}\Z")
TAKES_PERSON = re.compile(
    r"(?:找|给|跟|和|与|叫|请|让|向|对|问|约|陪|由|是|祝|等|见|、|，|(?:遇|碰|见|看|提|收|联系|想)到了?|(?:通知|转告|告诉|联系|联络|感谢|谢谢|采访|邀请|拜访|认识|介绍|听说|据说|推荐|任命|采访|代替|陪同|上次|刚才|最后|当时|这是|就是|还有|以及)了?"
    r"|同事|同学|朋友|邻居|队友|室友|经理|主任|医生|律师|司机|秘书|教授|老师|客户|导演|市长|总裁|主席|记者|工程师|队长|先生|女士)\Z"
)
# What goes on after a name: times, verbs that a person does, and particles.
PERSON_DOES = re.compile(
    r"说|表示|认为|告诉|打来|打电话|发来|来|去|已经|刚|正在|正|昨|今[天早晚年]|明[天早晚年]|后天|下[周午个]|上[周午个]|早上|晚上|周[一二三四五六日末]|同学|老师|先生|女士|和|与|跟|、|在|是|要|会|从|到|被|把|将|也|都|就|没|不|请假|请|拿|取|收(?![到据入费拾藏回集])"
    r"|的(?![确士话时])|负责|参加|主持|出生|毕业|写|打|发|带|等|想|签|同意|等|家|那[边里儿]|这[边里儿]|有|给|让|因|了|吗|吧|呢|现在|需要|可以|应该|必须"
)
# What hardly anything but a person has or does.
PERSONAL = re.compile(r"的(?:邮箱|邮件|电话|手机|号码|地址|身份证|生日|工资|家人|妻子|丈夫|孩子)|(?:今天|明天|昨天|下午|上午|刚刚?|已经)?(?:请假|迟到|出差|值班|辞职|生病|住院|结婚|离职|去世|出生)|[ 　]?收(?=[\s，,。]|$)|[ 　]?[(（]?\0")
NO_GIVEN = re.compile(rf"(?:{TITLES}|尴尬|咖啡|蝴蝶|葡萄|玻璃|垃圾|琵琶|蜘蛛|蚂蚁|喇叭|喷嚏|拖鞋|橘子|柠檬|玫瑰|馄饨|饺子)")
TIME = re.compile("[今明昨后]天|[今明昨][早晚年]|[上下]周|[早晚]上")
CUT_OFF = re.compile("[今明昨的请]?(?:…|[.]{3})")  # what went on after the name was cut off
#: Weights of the evidence for a Chinese name, and what they must add up to.
NAME_THRESHOLD = 3.0


def _given_weight(c: str) -> float:
    if c in PLAIN:
        return -2.0
    if c in GIVEN:
        return 1.0
    if c in SURNAMES:
        return 0.5
    try:
        return 1.0 if c.encode("gb2312")[0] >= 0xD8 else 0.3  # characters of the second level are rare outside names
    except UnicodeEncodeError:
        return 0.6


def han_names(t: str) -> Iterator[tuple[int, int]]:
    """Chinese full names in running text: a surname, one or two characters that may be a given name, and a context that takes a person.

    Each piece of evidence has a weight: how much the given name looks like one, what stands before (a label, a word that
    takes a person, or the start of a clause) and what follows (an end, or what persons do).
    """
    done = 0
    for m in HEAD.finditer(t):
        i, j = m.span()
        if i < done:
            continue
        before = t[max(0, i - 8) : i]
        last = before[-1:]
        if LABEL.search(before):
            left = 2.0
        elif TAKES_PERSON.search(before):
            left = 1.5 if last not in "，、" else 1.0
        else:
            left = 1.0 if not last or not (last.isalnum() or last == "_") else 0.0
        sure = 1.5 if j - i > 1 else 0.5 if m.group() in SURE_SURNAME else 0.0
        best, end = NAME_THRESHOLD, 0
        gap = 1 if t[j : j + 1] in (" ", "　") and left >= 1.0 and len(t) > j + 1 and "一" <= t[j + 1] <= "鿿" else 0
        for g in ((0, 1) if gap else (0,)):
            for k in (2, 1, 3):
                given = t[j + g : j + g + k]
                if len(given) < k or not all("一" <= c <= "鿿" for c in given) or any(TIME.match(t, j + g + q) for q in range(1, k)):
                    continue
                after = t[j + g + k : j + g + k + 4]
                if after[:1] and "一" <= after[0] <= "鿿":
                    right = 1.0 if PERSON_DOES.match(after) or CUT_OFF.match(after) else -1.0
                else:
                    right = 1.0 if not after[:1] or not (after[0].isalpha() or after[0] == "_") else 0.0
                    if after[:1] in (" ", "　") and len(after) > 1 and "一" <= after[1] <= "鿿" and left < 1.5:
                        right = 0.5
                if PERSONAL.match(t, j + g + k):
                    right = 1.5
                # without a word or a gap before it the surname may be the end of another word, and three characters are rare
                score = sure + left + right + sum(map(_given_weight, given)) - 0.25 * g - 0.5 * (left == 0.0) - 0.75 * (k == 3)
                if score > best or (score == best and not end):
                    best, end = score, j + g + k
        if end:
            name = re.sub(r"\s", "", t[i:end])
            if (STOP.fullmatch(name) if left >= 2.0 else STOP.match(name)) or NO_GIVEN.match(t, j) or TITLED.fullmatch(name):
                continue
            yield i, end
            done = end


_UP = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω" + "".join(chr(c) for c in range(0x100, 0x180) if chr(c).isupper())
_LOW = "a-zß-öø-ÿа-яёα-ωά-ώ" + "".join(chr(c) for c in range(0x100, 0x180) if chr(c).islower())
_W = rf"(?:[{_UP}]['’])?[{_UP}][{_LOW}]+(?:['’][{_LOW}]+)?(?:[{_UP}][{_LOW}]+)?(?:-[{_UP}][{_LOW}'’]+)*"
_U = rf"(?:[{_UP}]['’])?[{_UP}]{{2,}}(?:['’-][{_UP}]{{2,}})*"
NAME_EN = re.compile(rf"(?<![\w.{_UP}{_LOW}])(?:{_W}(?: [{_UP}]\.| {_W})? {_W}|{_U}(?: [{_UP}]\.)? {_U}|{_W}, {_W}(?: [{_UP}]\.)?|{_U}, {_U})(?![\w@{_UP}{_LOW}])", re.ASCII)
TWO_CAPITALS = re.compile(rf"[{_UP}][{_UP}{_LOW}.'’\-]*,? [{_UP}]")
NAME_LABELLED = re.compile(rf"(?<![\w])(?:name|full name|contact|kontakt|attn|signed|signed by|ansprechpartner(?:in)?|nom|nombre|имя|фио|контакт)\s?[:：]\s?(?P<n>[{_LOW}]{{2,}}(?:-[{_LOW}]+)?(?: [{_LOW}]{{2,}}(?:-[{_LOW}]+)?){{1,2}})(?=\s?(?:$|[\n,;，；。/|(]))", re.IGNORECASE)
HONORIFIC = re.compile(r"(?:Herr|Frau|Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Señora?|Sra?|Monsieur|Madame|Mme|Signora?|Senhora?|Pan|Pani)\.? ")
# Capitalised words that are no names: parts of streets, days, months, greetings, products and places.
NO_NAME = set(
    "street st road rd avenue ave lane ln close crescent drive dr way court ct boulevard blvd place pl square terrace unit apt apartment suite floor room block calle via rua rue plaza piazza platz strasse avenida "
    "the this that these those my our your his her monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "ssn id qq md pdf jpg png zip warn note error info ok re fw dear hello hi please thanks regards question read parcel order build row meet can who what when where why how i we they he she it no yes and or not is was are "
    "happy merry good morning evening night birthday christmas easter best kind warm new open source windows server office google apple microsoft amazon linux android north south east west san los saint "
    "tokyo shibuya osaka kyoto beijing shanghai london paris berlin rome madrid vienna moscow york jersey zealand delhi mumbai sydney toronto chicago boston texas california germany france spain italy japan china russia india canada australia england".split()
)
_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?(?:at|@)\s?[)\]}>]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\s(?:dot|DOT)\s)"
EMAIL = re.compile(rf"(?<![\w.+\-])(?P<l>[A-Za-z0-9][A-Za-z0-9._%+\-]*){_AT}(?P<d>[A-Za-z0-9][A-Za-z0-9\-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9\-]*)*{_DOT}[A-Za-z]{{2,24}})(?![A-Za-z0-9]|\s?@)", re.ASCII)
# File endings, which make the part behind an @ no mail domain.
FILES = set("png jpg jpeg gif bmp webp pdf doc docx xls xlsx ppt pptx txt zip rar csv log db mp3 mp4 amr avi psd slk exe html htm json xml tmp".split())
ID18 = re.compile(r"(?<![\dA-Za-z])[1-9]\d{5}[ \-\n]?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ \-\n]?\d{3}[\dXx](?![\dA-Za-z])", re.ASCII)
ID_ANY = re.compile(r"(?<![\dA-Za-z])[1-9](?:[ \-\n]?\d){16}[ \-\n]?[\dXx](?![\dA-Za-z])", re.ASCII)
PASSPORT = re.compile(r"(?<![\dA-Za-z])(?:[EGDSPHKM]\d{8}|E[A-HJ-NP-Z]\d{7})(?![\dA-Za-z])", re.ASCII)
SSN = re.compile(r"(?<![\w\-.])(?!000|9\d\d)\d{3}([- ])\d{2}\1\d{4}(?![\w\-])", re.ASCII)
PHONES = [
    re.compile(r"(?<![\w.\-/])(?:[(（]?(?:\+|00)86[)）]?[\- ]?|86[\- ])?(?<!\d)1[3-9]\d(?:\d{8}|([\- .])\d{4}\1\d{4}|[\- .]\d{8}|\d{2}[\- .]\d{6}|\d[\- .]\d{3}[\- .]\d{4})(?![\w\-])", re.ASCII),
    re.compile(r"(?<![\w.\-/])(?:[(（]?(?:\+|00)86[)）]?[\- ]?)?(?<!\d)1[3-9]\d*[ ]?\n[ ]?\d+(?![\w\-])", re.ASCII),
    re.compile(r"(?<![\w.\-/])(?:[(（]0\d{2,3}[)）][ \-]?|0\d{2,3}[\- ])[2-9]\d{2}[ \-]?\d{4,5}(?:[ ]?(?:转|ext\.?|x)[ ]?\d{1,6})?(?![\w\-])", re.ASCII),
    re.compile(r"(?<![\w.\-/+])(?:\+?1[\-. ])?(?:\([2-9]\d{2}\)[ \-]?|[2-9]\d{2}[\-. ])[2-9]\d{2}[\-. ]\d{4}(?![\w\-])(?!\.\d)", re.ASCII),
    re.compile(r"(?<![\w.\-/])(?:\+44|0044)[\- ]?\(?0?\)?\d{2,4}[\- ]?\d{3,4}[\- ]?\d{3,4}(?![\w\-])", re.ASCII),
    re.compile(r"(?<![\w.\-/])0(?:\d{4}[ \-]\d{6}|\d{2}[ \-]\d{4}[ \-]\d{4}|\d{3}[ \-]\d{3}[ \-]\d{4})(?![\w\-])", re.ASCII),
    re.compile(r"(?<![\w.\-/])\+[2-9]\d{0,2}(?:[\- ]?\(?\d{1,4}\)?){2,5}(?![\w\-])", re.ASCII),
]
SPOKEN = re.compile(r"(?<![幺一二三四五六七八九零〇])(?:幺|一)(?:[ \-]?[幺一二三四五六七八九零〇]){10}(?![幺一二三四五六七八九零〇])")
SPOKEN_DIGIT = {c: d for d, c in zip("0123456789", "零一二三四五六七八九")} | {"幺": "1", "〇": "0"}
#: What a number follows that is an order, group or account number rather than a telephone.
NUMBERED = re.compile(r"(?:单号|订单|流水号|群号|版本|时间戳|金额|价格|(?<![A-Za-z])(?:QQ|order|no\.|rand|row|build|parcel|seq))[：: #]{0,2}\Z", re.I)
_NUM = r"[ ]?(?:\d{1,5}|[零〇一二三四五六七八九十百千两]{1,6})"
STREET_ZH = re.compile(rf"(?P<city>(?:[{HAN}]{{2,4}}(?:省|自治区))?(?:[{HAN}]{{2,4}}(?:市|州|盟))?(?:[{HAN}]{{1,4}}(?:区|县|旗|镇|乡))?)(?P<road>[{HAN}]{{1,6}}?(?:路|街|巷|弄|大道|胡同|大街|道|里|坊|条)){_NUM}[ ]?(?:号(?!线|楼|院|群)|弄|号院|号楼|号院|巷)(?:[ ]?(?:\d{{1,5}}|[零〇一二三四五六七八九十百两]{{1,5}})[ ]?(?:号楼|号院|号|栋|幢|单元|室|层|楼|座))*(?:[ ]?\d{{3,4}}(?![\d]))?")
TO = re.compile("(?:(?:我|就|人)?(?:搬到|寄到|送到|寄往|住在|住|位于|地址是?|到|在|去|回))?")
STREET_FR = re.compile(rf"(?<![\w.\-/])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Qq]uai|[Cc]hemin|[Aa]llée|[Ii]mpasse|[Cc]ours)\s(?:(?:de|du|des|la|le|les)\s|[dl]['’])*{_W}(?:\s{_W}){{0,2}}", re.ASCII)
STREET_ES = re.compile(rf"(?<![\w])(?:Calle|Avenida|Av\.|Avda\.|Plaza|Paseo|Via|Viale|Corso|Piazza|Rua|Praça|Travessa)\s(?:(?:de|del|della|dei|la|las|los|da|do|dos|das)\s)*{_W}(?:\s(?:(?:de|del|la)\s)?{_W}){{0,2}},?\s\d{{1,4}}[a-z]?(?![\w.])", re.ASCII)
STREET_RU = re.compile(rf"(?:ул\.|улица|проспект|пр-т|пр\.|переулок|пер\.|бульвар|наб\.)\s?{_W}(?:\s{_W})?,?\s?(?:д\.|дом)?\s?\d{{1,4}}[а-я]?(?![\w])")
_TYPE = r"(?:Street|Str|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Crescent|Cres|Drive|Dr|Way|Court|Ct|Boulevard|Blvd|Place|Pl|Square|Sq|Terrace|Row|Hill|Gardens|Grove|Park|Walk|Mews)"
STREET_EN = re.compile(rf"(?<![\w.\-/])(?:(?:Unit|Apt|Flat|Suite)\s?\w{{1,5}},?\s)?\d{{1,5}}[A-Za-z]?,?\s(?:[A-Z][\w'’\-]*\s){{1,3}}?(?:{_TYPE}|{_TYPE.upper()})\b\.?(?:,?\s(?:Apt|Unit|Flat|Suite|APT|UNIT|#)\.?\s?\w{{1,5}})?", re.ASCII)
STREET_DE = re.compile(r"(?<![\w.\-/])[A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ\-]{2,}(?:weg|gasse|stieg|stra(?:ß|ss)e|str\.|platz|allee|ring|damm|ufer|steig|gracht|straat|laan|plein|kade|gade|gatan|WEG|GASSE|STIEG|STRASSE|PLATZ|ALLEE|RING)\s\d{1,4}[a-z]?(?![\w.])", re.ASCII)
STREET_JA = re.compile(rf"[{HAN}ぁ-んァ-ヶー]{{2,12}}\d{{1,3}}(?:丁目|番地?|[\-−]\d{{1,3}}[\-−]\d{{1,3}})(?:\d{{1,3}}番?(?:\d{{1,3}}号)?)?")
_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D, 0x2212: 0x2D, 0xA0: 0x20}
_KEEP = {c: c for c in map(ord, "，。；：！？（）")}
_FOLD = {k: v for k, v in _WIDE.items() if k not in _KEEP} | {ord("（"): ord("("), ord("）"): ord(")")}
DIGIT = re.compile(r"\d", re.ASCII)


class Finding(NamedTuple):
    start: int
    end: int
    kind: str


def valid_id18(text: str) -> bool:
    """Whether the check digit of an 18-digit resident number is right and its date exists."""
    s = re.sub(r"[^\dXx]", "", text).upper()
    if len(s) != 18:
        return False
    try:
        dt.date(int(s[6:10]), int(s[10:12]), int(s[12:14]))
    except ValueError:
        return False
    return check_digit(s[:17]) == s[17]


def check_digit(first17: str) -> str:
    """The check digit of a resident number: the weights are powers of two modulo 11."""
    return "10X98765432"[sum(int(c) * (2 ** (17 - i) % 11) for i, c in enumerate(first17)) % 11]


def find(text: str | None) -> list[Finding]:
    """All findings in a text, in order and without overlap. Full-width forms are read like their plain counterparts."""
    if not text:
        return []
    t = text.translate(_FOLD)
    found: list[Finding] = []

    def take(kind: str, start: int, end: int) -> None:
        nonlocal t
        found.append(Finding(start, end, kind))
        t = t[:start] + "\0" * (end - start) + t[end:]

    if "@" in t or " at " in t or "at)" in t or "at]" in t or " AT " in t:
        for m in EMAIL.finditer(t):
            labels = re.split(r"[^A-Za-z0-9\-]+", re.sub(r"\b(?:dot|DOT)\b", ".", m["d"]))
            if labels[-1].lower() in FILES or re.fullmatch(r"\dx", labels[0]):
                continue
            spelled = re.search(r"\s(?:at|AT)\s", t[m.end("l") : m.start("d")]) is not None
            if spelled and m["l"].lower() in ("me", "look", "meet", "be", "is", "left", "here", "us", "back"):
                continue
            take("email", m.start(), m.end())
    digits_in = DIGIT.search(t) is not None
    if digits_in:
        for m in ID18.finditer(t):
            if valid_id18(m.group()):
                take("id_number", m.start(), m.end())
        for m in ID_ANY.finditer(t):
            if valid_id18(m.group()):
                take("id_number", m.start(), m.end())
        for p in (PASSPORT, SSN):
            for m in p.finditer(t):
                take("id_number", m.start(), m.end())
        for i, p in enumerate(PHONES):
            for m in p.finditer(t):
                digits = re.sub(r"\D", "", re.split("转|ext|x", m.group())[0])
                if i == 1 and len(re.sub(r"^(?:0086|86)(?=1)", "", digits)) != 11:
                    continue
                if not 7 <= len(digits) <= 15 or NUMBERED.search(t[max(0, m.start() - 8) : m.start()]):
                    continue
                take("phone", m.start(), m.end())
    if "幺" in t or "一" in t:
        for m in SPOKEN.finditer(t):
            if SPOKEN_DIGIT[re.sub(r"[ \-]", "", m.group())[1]] in "3456789" and not NUMBERED.search(t[max(0, m.start() - 6) : m.start()]):
                take("phone", m.start(), m.end())
    if "号" in t or "弄" in t or "巷" in t:
        for m in STREET_ZH.finditer(t):
            take("address", m.start() + len(TO.match(m.group()).group()), m.end())
    if digits_in:
        for p in (STREET_FR, STREET_ES, STREET_RU, STREET_EN, STREET_DE, STREET_JA):
            for m in p.finditer(t):
                take("address", m.start(), m.end())
    for start, end in han_names(t):
        take("person_name", start, end)
    at = 0
    several = TWO_CAPITALS.search(t) is not None
    while several and (m := NAME_EN.search(t, at)):
        start, words = m.start(), m.group().split()
        titled = HONORIFIC.match(t, start)
        if any(w.lower().strip(".,") in NO_NAME for w in words):
            at = start + len(words[0])  # a name may begin within
        elif titled and "," not in m.group():
            at = titled.end()
        else:
            take("person_name", start, m.end())
            at = m.end()
    if ":" in t or "：" in t:
        for m in NAME_LABELLED.finditer(t):
            if not any(w in NO_NAME for w in m["n"].split()):
                take("person_name", m.start("n"), m.end("n"))
    return sorted(found)


# ------------------------------------------------------------------------------------------------ surrogates

# Parts of surrogate names and streets; by gender where the part tells it.
GIVEN_F, GIVEN_M, GIVEN_N = "anna clara edith flora helen irene julia laura nora vera".split(), "adam carl edgar felix henry ivan julius leon oscar victor".split(), "alex casey jamie kim lee morgan quinn robin sam taylor".split()
CYRILLIC_F, CYRILLIC_M = "анна вера дарья елена ирина мария нина ольга софия юлия".split(), "андрей борис виктор глеб денис егор иван максим олег павел".split()
ZH_F, ZH_M, ZH_N = "娜婷娟燕莉芳丽敏慧萍霞静婉玲琴秀英兰雅怡", "伟强军磊勇刚峰涛斌浩杰鹏超龙辉武毅雄宏威", "文宁晨晓平安林然青新明华思远子嘉一亦乐凡"
FEMALE_SIGNS, MALE_SIGNS = set(ZH_F + "妍倩蕾薇妹姐媛玉凤"), set(ZH_M + "国志彬亮")
STREETS_ZH, STREETS_EN, STREETS_DE = "松梅桂柳枫石竹荷兰桃杏槐榆桐枣梨菊葵橘茶", "Alder Birch Cedar Elm Hazel Juniper Maple Willow Aspen Rowan".split(), "Ahorn Birken Eichen Fichten Linden Ulmen Buchen Erlen Weiden Tannen".split()
_ONSETS = ("b d f g k l m n p r s t v w st br".split(), "б в г д к л м н п р с т з ж ст др".split())
_VOWELS = ("aeiou", "аеиоу")
_ENDS = ("n l r s nd rt x th ck m".split(), "ов ев ин ский ый ко ич ец ук як".split())


class Draw:
    """Choices taken one after the other from a keyed number."""

    def __init__(self, n: int) -> None:
        self.n = n

    def of(self, pool: str | list[str]) -> str:
        self.n, i = divmod(self.n, len(pool))
        return pool[i]

    def number(self, size: int) -> int:
        self.n, i = divmod(self.n, size)
        return i

    def word(self, syllables: int, cyrillic: bool = False) -> str:
        """A word that can be spoken, of some syllables."""
        return "".join(self.of(_ONSETS[cyrillic]) + self.of(_VOWELS[cyrillic]) for _ in range(syllables)) + self.of(_ENDS[cyrillic])


def canonical(kind: str, text: str) -> str:
    """The form under which two mentions are the same entity."""
    t = text.translate(_FOLD)
    if kind == "email":
        t = re.sub(r"\s?[(\[{<]?\s?\b(?:at|AT)\b\s?[)\]}>]?\s?", "@", t)
        return re.sub(r"\s", "", re.sub(r"\s?[(\[{]?\s?\b(?:dot|DOT)\b\s?[)\]}]?\s?", ".", t)).lower()
    if kind == "phone":
        t = "".join(SPOKEN_DIGIT.get(c, c) for c in t)
        return re.sub(r"^(?:0086|86)(?=1\d{10})", "", re.sub(r"\D", "", t))
    if kind == "id_number":
        return re.sub(r"[^0-9A-Za-z]", "", t).upper()
    if kind == "person_name" and re.search("[A-Za-z]", t):
        parts = t.split(",")
        return re.sub(r"\s+", " ", " ".join(reversed(parts)) if len(parts) == 2 else t).strip().lower()
    return re.sub(r"\s", "", t).lower()


def script_of(entity: str) -> str:
    """han, cyrillic or latin, by the first letter that tells."""
    for c in entity:
        if "一" <= c <= "鿿" or "ぁ" <= c <= "ヿ":
            return "han"
        if "а" <= c.lower() <= "ё":
            return "cyrillic"
    return "latin"


class Surrogates:
    """Keyed replacements of the same type, script, gender and format; equal entities get equal replacements.

    ``widths`` says how many more syllables, characters or digits replacements of a kind and script have than the
    shortest, ``redrawn`` which entities are drawn again and how often: both are what ``collision_free`` decides.
    """

    #: How many replacements there are of a kind and script at width 0, and how many times more with each step.
    ROOM = {("person_name", "han"): (120_000, 20), ("person_name", "latin"): (640_000, 80), ("person_name", "cyrillic"): (640_000, 80), ("email", "latin"): (230_000_000, 80), ("address", "han"): (1_200_000, 20), ("address", "latin"): (1_600_000, 80), ("address", "cyrillic"): (640_000, 80)}

    def __init__(self, key: bytes, widths: dict[tuple[str, str], int] | None = None, redrawn: dict[tuple[str, str], int] | None = None) -> None:
        self.key, self.widths, self.redrawn = key, widths or {}, redrawn or {}

    def _number(self, kind: str, entity: str) -> int:
        tweak = self.redrawn.get((kind, entity), 0)
        return int.from_bytes(hmac.new(self.key, f"{tweak}|{kind}|{entity}".encode(), hashlib.sha256).digest(), "big")

    def permuted(self, kind: str, x: int, n: int) -> int:
        """A keyed permutation of 0..n-1: different numbers stay different, however many there are."""
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for i in range(4):
                left = (left + self._number(f"{kind}/{n}/{i}/l", str(right))) % a
                right = (right + self._number(f"{kind}/{n}/{i}/r", str(left))) % b
            x = left * b + right
            if x < n:
                return x

    def _digits(self, kind: str, digits: str) -> str:
        return f"{self.permuted(kind, int(digits), 10 ** len(digits)):0{len(digits)}d}" if digits else ""

    def of(self, kind: str, entity: str, gender: str = "") -> str:
        """The replacement of an entity, in its canonical form.

        Numbers are permuted within their format, so they never collide: telephones keep their first three digits,
        resident numbers province and parity (gender) and stay valid, other numbers their letters.
        """
        if kind == "phone" and entity.isdigit():
            keep = 3 if len(entity) > 6 else 0
            return entity[:keep] + self._digits(f"phone{entity[:keep]}", entity[keep:])
        if kind == "id_number":
            if valid_id18(entity):
                first_day, days = dt.date(1900, 1, 1), 73_049
                day = (dt.date(int(entity[6:10]), int(entity[10:12]), int(entity[12:14])) - first_day).days
                if 0 <= day < days:
                    seq, odd = divmod(int(entity[14:17]), 2)
                    x = self.permuted(f"id{entity[:2]}{odd}", (int(entity[2:6]) * days + day) * 500 + seq, 10_000 * days * 500)
                    x, seq = divmod(x, 500)
                    region, day = divmod(x, days)
                    born = first_day + dt.timedelta(days=day)
                    first = f"{entity[:2]}{region:04d}{born:%Y%m%d}{seq * 2 + odd:03d}"
                    return first + check_digit(first)
            return re.sub(r"\d+", lambda m: self._digits("id", m.group()), entity)
        script = script_of(entity)
        d, wide = Draw(self._number(kind, entity)), self.widths.get((kind, script), 0)
        if kind == "email":
            return f"{d.of(GIVEN_N)}.{d.word(2 + wide)}{d.number(90) + 10}@{d.word(1)}.invalid"
        if kind == "address":
            if script == "han":
                return f"{d.of(STREETS_ZH)}{d.of(ZH_N)}{''.join(d.of(ZH_N) for _ in range(wide))}{d.of('路街巷')}{d.number(999) + 1}号"
            if script == "cyrillic":
                return f"ул. {d.word(2 + wide, True).capitalize()}, {d.number(99) + 1}"
            if re.search(r"[a-zäöüß](?:weg|gasse|stieg|stra(?:ß|ss)e|platz|allee|ring|damm|ufer|steig|str\.)\s?\d", entity):
                return f"{d.of(STREETS_DE)}{d.word(1 + wide)}weg {d.number(999) + 1}"
            return f"{d.number(999) + 1} {d.of(STREETS_EN)} {d.word(1 + wide).capitalize()} Street"
        gender = gender or gender_of(entity)
        if script == "han":
            pool = {"f": ZH_F, "m": ZH_M}.get(gender, ZH_N)
            surname = d.of(SURNAMES)
            return surname + "".join(d.of(pool) for _ in range(2 + wide))
        if script == "cyrillic":
            return f"{d.of(CYRILLIC_F if gender == 'f' else CYRILLIC_M)} {d.word(2 + wide, True)}{'а' if gender == 'f' else ''}"
        given, middle = d.of({"f": GIVEN_F, "m": GIVEN_M}.get(gender, GIVEN_N)), d.of("abcdefghjklmnoprstw")
        family = d.word(2 + wide)
        parts = re.split(r"\s", entity)
        return " ".join([given, *([f"{middle}."] if len(parts) > 2 and re.fullmatch(r"\w\.", parts[1]) else []), f"{family}-{d.word(1)}" if "-" in parts[-1] else family])

    def written(self, kind: str, text: str) -> str:
        """The replacement in the notation of the text: separators, width and letter case."""
        s = self.of(kind, canonical(kind, text))
        if kind in ("phone", "id_number"):
            digits = iter(s)
            plain = text.translate(_FOLD)
            lead = len(re.match(r"[(]?(?:\+|00)86[)]?|86(?=[\- ])", plain).group()) if kind == "phone" and re.match(r"[(]?(?:\+|00)86|86[\- ]", plain) else 0
            out = []
            for i, c in enumerate(text):
                p = plain[i]
                if i < lead or not (p.isalnum() and p.isascii() or p in SPOKEN_DIGIT):
                    out.append(c)
                else:
                    d = next(digits, "")
                    out.append("零幺二三四五六七八九"[int(d)] if p in SPOKEN_DIGIT and d.isdigit() else chr(ord(d) + 0xFEE0) if ord(c) > 0xFF00 and d else d)
            return "".join(out)
        if kind == "email":
            return s.upper() if text.isupper() else s
        if kind == "person_name" and script_of(text) != "han":
            if not text.islower():
                s = re.sub(r"(?<![^\W_])[^\W_]", lambda m: m.group().upper(), s)
            if "," in text:
                given, family = s.rsplit(" ", 1)
                s = f"{family}, {given}"
        elif kind == "person_name" and re.search(r"\s", text):
            s = f"{s[0]}{re.search(r'\s', text).group()}{s[1:]}"
        return s.upper() if text.isupper() else s


def gender_of(name: str) -> str:
    """f or m where the characters of a Chinese given name, or the ending of another, suggest it, else ''."""
    if script_of(name) == "han":
        given = set(name[1:])
        return "f" if given & FEMALE_SIGNS else "m" if given & MALE_SIGNS else ""
    first = name.split(" ")[0]
    return "f" if first.endswith(("a", "ie", "а", "я")) else "m" if first.endswith(("s", "n", "k", "c", "d", "r", "н", "р", "й", "л", "г", "м")) else ""


# ------------------------------------------------------------------------------------------------ operators

PLACEHOLDER = "[{kind}:{surrogate}]"


def find_personal(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per finding: the key columns, field, pii_kind, start, end (characters), found and entity (canonical).

    Kinds are email, phone, id_number, address and person_name. Null and blank texts hold nothing; repeated rows give
    repeated findings; whole texts are read. Nothing is shuffled, and a text that a batch holds several times, or in
    several fields, is read once.
    """
    narrow = df.select(*keys, *[F.col(f).alias(f"_t{i}") for i, f in enumerate(fields)])
    schema = narrow.select(*keys, F.lit("").alias("field"), F.lit("").alias("pii_kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("found"), F.lit("").alias("entity")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str | None, list[Finding]] = {}
            rows, out = [], []
            for i, f in enumerate(fields):
                for r, text in enumerate(b.column(len(keys) + i).to_pylist()):
                    hits = seen.get(text)
                    if hits is None:
                        hits = seen[text] = find(text)
                    for h in hits:
                        found = text[h.start : h.end]
                        rows.append(r)
                        out.append((f, h.kind, h.start, h.end, found, canonical(h.kind, found)))
            if rows:
                kept = b.select(range(len(keys))).take(pa.array(rows))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()])]], names=[*keys, "field", "pii_kind", "start", "end", "found", "entity"])

    return narrow.mapInArrow(run, schema)


def collision_free(entities: DataFrame, key: bytes, *, rounds: int = 12, most_redrawn: int = 20_000) -> Surrogates:
    """Surrogates that keep all entities (pii_kind, entity) apart, by script.

    The number of entities of a kind and script decides how long their replacements are: so long that at most some
    ``most_redrawn`` / 20 pairs are expected to collide by chance. All entities are then replaced; of those that share a
    replacement the first keeps it and the others are drawn again, until there are none. Only these reach the driver;
    were they more than ``most_redrawn``, replacements get longer instead.
    """
    known = entities.select("pii_kind", "entity").dropna().distinct()
    script = F.udf(script_of, "string", useArrow=True)
    widths: dict[tuple[str, str], int] = {}
    for r in known.withColumn("script", script("entity")).groupBy("pii_kind", "script").count().collect():
        room, step = Surrogates.ROOM.get((r.pii_kind, r.script), (1, 0))
        while step and r["count"] ** 2 / 2 / room > most_redrawn / 20:
            room, widths[(r.pii_kind, r.script)] = room * step, widths.get((r.pii_kind, r.script), 0) + 1
    redrawn: dict[tuple[str, str], int] = {}
    for _ in range(rounds):
        s = Surrogates(key, dict(widths), dict(redrawn))
        made = known.withColumn("surrogate", F.udf(lambda k, e, s=s: canonical(k, s.of(k, e)), "string", useArrow=True)("pii_kind", "entity"))
        shared = made.groupBy("pii_kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("first")).where("n > 1")
        again = made.join(shared, ["pii_kind", "surrogate"]).where("entity <> first").select("pii_kind", "entity").limit(most_redrawn + 1).collect()
        if not again:
            return s
        if len(again) > most_redrawn:
            widths = {k: widths.get(k, 0) + 1 for k in Surrogates.ROOM}
            redrawn = {}
        for r in again[:most_redrawn]:
            redrawn[(r.pii_kind, r.entity)] = redrawn.get((r.pii_kind, r.entity), 0) + 1
    raise ValueError("no collision-free surrogates were found; give another key or more rounds")


def mask_personal(df: DataFrame, fields: list[str], *, key: bytes, placeholder: str = PLACEHOLDER, surrogates: Surrogates | None = None) -> DataFrame:
    """``df`` with ``<field>_masked`` per field: each finding replaced by a typed placeholder that holds its surrogate.

    Surrogates are keyed, so the same entity has the same one in every row, table and run with the same key; a check
    over all entities of the fields makes sure that different entities stay different. Numbers are permuted, which who
    has the key can undo: keep it like a password. All else in the texts is unchanged, null stays null. Other columns pass through; the result's new columns replace columns of the same name.
    """
    if surrogates is None:
        found = materialise(find_personal(df, [], fields).select("pii_kind", "entity").distinct(), "entities")
        surrogates = collision_free(found, key)
    s = surrogates

    def masked(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            # a text that a batch holds several times, or in several fields, is read once
            seen: dict[str | None, str | None] = {None: None}
            out = []
            for a in columns:
                for t in a.to_pylist():
                    if t not in seen:
                        parts, at = [], 0
                        for h in find(t):
                            parts += [t[at : h.start], placeholder.format(kind=h.kind.upper(), surrogate=s.written(h.kind, t[h.start : h.end]))]
                            at = h.end
                        seen[t] = "".join([*parts, t[at:]]) if at else t
                out.append(pa.array([seen[t] for t in a.to_pylist()], pa.string()))
            yield pa.StructArray.from_arrays(out, names=[f"m{i}" for i in range(len(out))])

    masked.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(masked, ", ".join(f"m{i} string" for i in range(len(fields))))(*[F.col(f) for f in fields])
    kept = df.drop(*[f"{f}_masked" for f in fields])
    return kept.select("*", made.alias("_masked")).select(*kept.columns, *[F.col(f"_masked.m{i}").alias(f"{f}_masked") for i, f in enumerate(fields)])
