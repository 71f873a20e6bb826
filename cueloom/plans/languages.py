"""Languages that a player offers for translated captions."""

from __future__ import annotations

#: Language codes and names as players on large screens show them, in their order.
NAMES = """
sq=Shqip - 阿尔巴尼亚语
ak=Ákán - 阿肯语
ar=العربية - 阿拉伯语
am=አማርኛ - 阿姆哈拉语
as=অসমীয়া - 阿萨姆语
az=آذربايجان ديلی - 阿塞拜疆语
ee=Èʋegbe - 埃维语
ay=Aymar aru - 艾马拉语
ga=Gaeilge - 爱尔兰语
et=Eesti - 爱沙尼亚语
or=ଓଡ଼ିଆ - 奥里亚语
om=Afaan Oromoo - 奥罗莫语
eu=Euskara - 巴斯克语
be=Беларуская - 白俄罗斯语
bg=Български - 保加利亚语
nso=Sesotho sa Leboa - 北索托语
is=Íslenska - 冰岛语
pl=Polski - 波兰语
bs=Bosanski - 波斯尼亚语
fa=فارسی - 波斯语
bho=भोजपुरी - 博杰普尔语
ts=Xitsonga - 聪加语
tt=Татарча - 鞑靼语
da=Dansk - 丹麦语
de=Deutsch - 德语
dv=ދިވެހިބަސް - 迪维希语
ru=Русский - 俄语
fr=français - 法语
sa=संस्कृतम् - 梵语
fil=Filipino - 菲律宾语
fi=suomi - 芬兰语
km=ភាសាខ្មែរ - 高棉语
ka=ქართული - 格鲁吉亚语
gu=ગુજરાતી - 古吉拉特语
gn=Avañe'ẽ - 瓜拉尼语
kk=Қазақ тілі - 哈萨克语
ht=Kreyòl ayisyen - 海地克里奥尔语
ko=한국어 - 韩语
ha=هَوُسَ - 豪萨语
nl=Nederlands - 荷兰语
gl=Galego - 加利西亚语
ca=català - 加泰罗尼亚语
cs=čeština - 捷克语
kn=ಕನ್ನಡ - 卡纳达语
ky=кыргыз тили - 吉尔吉斯语
xh=isiXhosa - 科萨语
co=corsu - 科西嘉语
hr=hrvatski - 克罗地亚语
qu=Runa Simi - 克丘亚语
ku=Kurdî - 库尔德语
la=lingua latīna - 拉丁语
lv=latviešu valoda - 拉脱维亚语
lo=ພາສາລາວ - 老挝语
lt=lietuvių kalba - 立陶宛语
ln=lingála - 林加拉语
lg=Luganda - 卢干达语
lb=Lëtzebuergesch - 卢森堡语
rw=Kinyarwanda - 卢旺达语
ro=Română - 罗马尼亚语
mt=Malti - 马耳他语
mr=मराठी - 马拉地语
mg=Malagasy - 马拉加斯语
ml=മലയാളം - 马拉雅拉姆语
ms=bahasa Melayu - 马来语
mk=македонски јазик - 马其顿语
mi=te reo Māori - 毛利语
mn=Монгол хэл - 蒙古语
bn=বাংলা - 孟加拉语
my=ဗမာစာ - 缅甸语
hmn=Hmoob - 苗语
af=Afrikaans - 南非荷兰语
st=Sesotho - 南索托语
ne=नेपाली - 尼泊尔语
no=Norsk - 挪威语
pa=ਪੰਜਾਬੀ - 旁遮普语
pt=Português - 葡萄牙语
ps=پښتو - 普什图语
ny=chiCheŵa - 齐切瓦语
ja=日本語 - 日语
sv=Svenska - 瑞典语
sm=Gagana fa'a Samoa - 萨摩亚语
sr=Српски језик - 塞尔维亚语
si=සිංහල - 僧伽罗语
sn=ChiShona - 绍纳语
eo=Esperanto - 世界语
sk=slovenčina - 斯洛伐克语
sl=slovenščina - 斯洛文尼亚语
sw=Kiswahili - 斯瓦希里语
gd=Gàidhlig - 苏格兰盖尔语
ceb=Binisaya - 宿务语
so=Soomaaliga - 索马里语
tg=тоҷикӣ - 塔吉克语
te=తెలుగు - 泰卢固语
ta=தமிழ் - 泰米尔语
th=ไทย - 泰语
ti=ትግርኛ - 提格利尼亚语
tr=Türkçe - 土耳其语
tk=Türkmen - 土库曼语
cy=Cymraeg - 威尔士语
ug=ئۇيغۇرچە - 维吾尔语
und=Unknown - 未知语言
ur=اردو - 乌尔都语
uk=українська - 乌克兰语
uz=O'zbek - 乌兹别克语
es=Español - 西班牙语
fy=Frysk - 西弗里西亚语
iw=עברית - 希伯来语
el=Ελληνικά - 希腊语
haw=ʻŌlelo Hawaiʻi - 夏威夷语
sd=سنڌي - 信德语
hu=magyar - 匈牙利语
su=Basa Sunda - 巽他语
hy=հայերեն - 亚美尼亚语
ig=Igbo - 伊博语
it=Italiano - 意大利语
yi=ייִדיש - 意第绪语
hi=हिन्दी - 印地语
id=Bahasa Indonesia - 印度尼西亚语
en=English - 英语
yo=Yorùbá - 约鲁巴语
vi=Tiếng Việt - 越南语
jv=Basa Jawa - 爪哇语
zh-Hant=中文（繁體）- 中文（繁体）
zh-Hans=中文（简体）
zu=isiZulu - 祖鲁语
kri=Krìì - 克里语
"""

#: Names that players on phones show otherwise.
MOBILE_NAMES = """
az=Azərbaycanca - 阿塞拜疆语
ee=Eʋegbe - 埃维语
ay=Aymar - 艾马拉语
om=Oromoo - 奥罗莫语
fr=Français - 法语
fi=Suomi - 芬兰语
ht=海地克里奥尔语
ko=한국말 - 韩语
ca=Català - 加泰罗尼亚语
cs=Čeština - 捷克语
ky=Кыргызча - 吉尔吉斯语
co=Corsu - 科西嘉语
hr=Hrvatski - 克罗地亚语
lv=Latviešu - 拉脱维亚语
lo=ລາວ - 老挝语
lt=Lietuvių - 立陶宛语
ln=Lingála - 林加拉语
ms=Bahasa Melayu - 马来语
mk=македонски - 马其顿语
mi=Māori - 毛利语
mn=Монгол - 蒙古语
sm=Gagana Samoa - 萨摩亚语
sk=Slovenčina - 斯洛伐克语
sl=Slovenščina - 斯洛文尼亚语
ceb=Cebuano - 宿务语
uk=Українська - 乌克兰语
uz=O‘zbek - 乌兹别克语
hu=Magyar - 匈牙利语
hy=Հայերեն - 亚美尼亚语
zh-Hant=中文（繁體） - 中文（繁体）
"""

#: The player's codes of languages and those that the caption service knows them by.
SERVICE_CODES = """
BG=bg-BG CS=cs DA=da-DK DE=de EL=el EN=en EN-GB=en-GB EN-US=en-US ES=es ES-419=es-419 ES-ES=es-ES ET=et-EE FI=fi FR=fr HU=hu-HU
ID=id IS=is-IS IT=it JA=ja KO=ko LT=lt-LT LV=lv-LV NL=nl-NL NO=nb-NO PL=pl-PL PT=pt PT-PT=pt-PT PT-BR=pt-BR RO=ro-RO RU=ru-RU
SK=sk-SK SL=sl-SI SV=sv-SE YUE=yue YUE-HK=yue-HK ZH=zh ZH-HANS=zh-Hans ZH-HK=zh-Hant-HK ZH-HANT=zh-Hant ZH-TW=zh-TW
"""


def table(text: str, separator: str | None = "\n") -> dict[str, str]:
    return dict(line.split("=", 1) for line in text.strip().split(separator))


DESKTOP = table(NAMES)
MOBILE = DESKTOP | table(MOBILE_NAMES)
#: One code has a space in it.
CODES = table(SERVICE_CODES, None) | {"EN-US SDH": "en-US SDH"}
