"""Tables of the advert classes: 27 scores on five axes and 47 kinds. All names, patterns, points and limits are fixed values."""

from __future__ import annotations

from shokuba.operators.rules import Axes, Between, Holds, Is, Kind, Length, Number, Points, Score, TagCount, Tags, Texts, Total

# -- fixed values: scores


def _tag(name: str, points: int = 1) -> Points:
    return Points(Tags([name]), points)


def _texts(*patterns: str, per: int = 1, most: int | None = None) -> Points:
    return Points(Texts(patterns), per, most)


def _is(column: str, points: int, *values: str) -> Points:
    return Points(Is(column, values), points)


_YEARS = Number("required_experience_years", 0)
_LIMIT = Number("age_limit")
_CONTENT = Number("content_richness_score", 0)
_DECADE, _QUALIFIED, _STAGE = "age_decade_primary", "exp_qual_segment", "lifecycle_primary"
_LICENCE = r"(介護福祉士|初任者研修|実務者研修|正看護師|准看護師|保育士).{0,5}(必須|必要|以上)"
_LICENCE_HELD = r"(資格|免許).{0,5}(お持ち|をお持ち|ある方)"
_VISION = (r"理念", r"ビジョン", r"ミッション", r"社会貢献", r"地域.{0,5}(貢献|密着|支え)", r"やりがい", r"想い", r"志", r"未来", r"100年", r"その人らしく")
_PLACE = (
    r"アットホーム", r"風通し.{0,5}良", r"チームワーク", r"人間関係.{0,5}良", r"相談.{0,5}(できる|しやすい)", r"先輩.{0,5}(サポート|フォロー)", r"仲間", r"雰囲気.{0,5}良",
    r"話しやすい", r"意見.{0,5}(出せる|言える|反映)",
)

AXES: Axes = {
    "A": {
        "A1": Score(
            "完全未経験歓迎",
            [
                _tag("未経験可"), _tag("無資格可", 2), _tag("資格不問"), _tag("学歴不問"), _tag("新卒可", 2),
                _texts(r"一から", r"イチから", r"ゼロから", r"初めての方", r"はじめての方"),
                _texts(r"丁寧に.{0,5}教え", r"安心してスタート", r"しっかり(サポート|フォロー)"),
                _is(_QUALIFIED, 3, "未経験＋無資格"), _is(_QUALIFIED, -2, "未経験＋有資格"),
                _texts(r"(介護福祉士|初任者研修|実務者研修|正看護師|保育士).{0,5}(必須|必要)", per=-3),
            ],
            most=8,
            never=Between(_YEARS, 1, 999),
        ),
        "A2": Score(
            "未経験可（資格あり）",
            [
                _tag("未経験可", 2), _texts(_LICENCE, _LICENCE_HELD, per=2, most=1), _texts(r"資格さえ", r"資格があれば", r"訪問.{0,5}未経験.{0,3}(OK|可)"),
                Points(Texts([_LICENCE, _LICENCE_HELD]), steps=((1, 0), (0, -5))),
            ],
            never=Between(_YEARS, 1, 999),
        ),
        "A3": Score("軽度経験（1-2年）", [_tag("ブランク可"), _texts(r"経験(が)?浅くても", r"少しでも経験")], base=3, never=Total([Between(_YEARS, 0, 0), Between(_YEARS, 3, 999)])),
        "A4": Score(
            "即戦力経験者",
            [
                Points(_YEARS, steps=((3, 4), (1, 1))), _texts(r"即戦力", r"管理(職)?経験", r"リーダー経験", r"経験者(優遇|歓迎|求む)"),
                _texts(r"臨床経験\d+年", r"実務経験\d+年以上"), _tag("未経験可", -2),
            ],
        ),
        "A5": Score(
            "復職・ブランク者",
            [
                _tag("ブランク可", 2), _tag("復職支援", 2), _texts(r"ブランク.{0,5}(OK|可|歓迎|問いません|ある方も)", r"復職", r"現場復帰", r"お仕事復帰", r"育児.{0,5}(明け|から)"),
                Points(Between(Total([Is(_QUALIFIED, ["経験者＋有資格"]), Tags(["ブランク可"])]), 2, 2), 2), _tag("新卒可", -2),
            ],
        ),
    },
    "B": {
        "B1": Score(
            "新卒・第二新卒",
            [
                _tag("新卒可"), _texts(r"新卒(歓迎|募集|採用)", r"第二新卒", r"2[5-8]卒", per=2), _texts(r"新卒", r"卒業見込"),
                Points(_LIMIT, steps=((35.5, 0), (30.5, 1), (-999, 2))),
            ],
        ),
        "B2": Score(
            "若手成長層",
            [
                _texts(r"20代", r"30代", r"若手", r"キャリアアップ", r"キャリアパス", r"ステップアップ", r"成長できる", r"将来.{0,5}(幹部|管理職|リーダー)"),
                _texts(r"髪(色|型).{0,3}(自由|OK)", r"ネイル.{0,3}(自由|OK)", r"ピアス.{0,3}(自由|OK)", r"服装.{0,3}自由", r"20.{0,2}30代.{0,5}(中心|活躍|多い)", r"平均年齢.{0,3}(2\d|3[0-5])歳"),
                Points(Between(_LIMIT, 36, 45)), _is(_DECADE, 2, "20代", "30代"), Points(Tags(["新卒可"]), -1), Points(Between(Length("education_training"), 201, 10**9)),
            ],
            base=1,
        ),
        "B3": Score(
            "ミドル層",
            [
                _tag("40代活躍", 2), _texts(r"40代", r"ミドル", r"30代.{0,5}40代", r"管理職経験", r"即戦力"),
                _texts(r"家庭.{0,5}(両立|と両立)", r"子育て.{0,5}(しながら|中の方)", r"(30|40)代.{0,5}(中心|活躍|多い)", r"平均年齢.{0,3}(3[5-9]|4\d)歳", r"経験(を|が)活かせる"),
                Points(Between(_LIMIT, 50, 64)), _is(_DECADE, 2, "40代", "50代"), _is(_DECADE, 1, "30代"),
            ],
        ),
        "B4": Score(
            "シニア層",
            [
                _tag("50代活躍", 2), _tag("60代活躍", 2), _texts(r"50代", r"60代", r"シニア", r"セカンドキャリア", r"定年後"),
                Points(_LIMIT, steps=((65, 1),)), _texts(r"再雇用(制度)?あり", r"定年(後|65|70)"),
            ],
        ),
        "B5": Score(
            "年齢不問・幅広い層",
            [
                _tag("年齢不問", 3), Points(Tags(["40代活躍", "50代活躍", "60代活躍"]), steps=((2, 3), (1, 1))),
                _texts(r"年齢.{0,3}(不問|問いません|問わず)", r"幅広い年齢", r"年齢(は|を)問", r"どなたでも"),
            ],
        ),
    },
    "C": {
        "C1": Score(
            "フルタイム・キャリア志向",
            [
                Points(Holds("employment_type", ["正職員"]), 2), _tag("資格取得支援"), _tag("研修制度あり"),
                _texts(r"キャリアアップ", r"キャリアパス", r"スキルアップ", r"昇格", r"昇進", r"管理職", r"リーダー", r"ステップアップ"),
                Points(Between(Length("education_training"), 301, 10**9)), Points(Holds("service_type", ["病院", "総合病院", "大学病院", "医療センター"])),
            ],
        ),
        "C2": Score(
            "WLB重視",
            [
                _tag("日勤のみ可", 2), _tag("残業ほぼなし", 2), _tag("年間休日120日以上"), _tag("4週8休以上"),
                _texts(r"ワークライフバランス", r"プライベート.{0,5}(充実|大切|両立)", r"残業(ほぼ)?なし", r"定時退社", r"持ち帰り.{0,5}なし", r"週休3日"),
                _texts(r"テレワーク", r"リモートワーク", r"在宅勤務", per=2), _texts(r"フレックス(タイム)?", r"時差出勤"),
                Points(Number("annual_holidays", 0), steps=((120, 1),)), _is("wh_overtime", 1, "残業なし", "残業ほぼなし"), _is("wh_shift_type", 1, "日勤のみ", "固定時間"),
            ],
        ),
        "C3": Score(
            "子育て・家庭両立型",
            [
                _tag("主夫・主婦OK", 2), _tag("育児支援あり"), _tag("家庭都合休OK"),
                _texts(
                    r"主婦", r"主夫", r"扶養内", r"扶養範囲", r"家庭と両立", r"子育て(しながら|中|ママ)", r"育児中", r"時短勤務", r"お子さん.{0,5}(いる|いらっしゃる)", r"託児",
                    r"産(前|後)休暇", r"育(児|休)", r"ママ(さん)?歓迎", most=4,
                ),
                _is(_STAGE, 2, "育児期", "結婚・出産期"), _is(_STAGE, 1, "復職期"),
            ],
            most=8,
        ),
        "C4": Score(
            "Wワーク・副業・短時間",
            [
                _tag("副業OK", 2), _tag("WワークOK", 2), _tag("フリーターOK"), Points(Holds("employment_type", ["パート", "バイト"]), 2),
                _texts(r"フリーター", r"Wワーク", r"ダブルワーク", r"副業", r"掛け持ち", r"スキマ時間", r"短時間"),
            ],
        ),
        "C5": Score(
            "安定・長期就業型",
            [
                _tag("退職金あり"),
                _texts(r"退職金", r"永年勤続", r"勤続表彰", r"長く働", r"腰を据え", r"正(社員|職員)登用", r"再雇用(制度)?あり", r"安定した(経営|基盤)", r"創業\d+年", r"設立\d+年"),
            ],
        ),
    },
    "D": {
        "D1": Score(
            "収入アップ訴求",
            [
                _texts(r"想定年収", r"モデル年収", r"年収\d{3}万"), _texts(r"高(給|収入|年収|時給)", r"インセンティブ", r"歩合", per=2), _texts(r"お祝い金", r"入社祝", r"支度金"),
                Points(Number("bonus_count", 0), steps=((4, 1),)), Points(Number("salary_min", 0), steps=((350000, 2), (300000, 1))), Points(Number("salary_max", 0), steps=((450000, 1),)),
            ],
        ),
        "D2": Score(
            "安定性・規模訴求",
            [
                _texts(r"上場", r"大手", r"全国\d+.{0,3}(事業所|拠点|施設)", r"創業\d+年", r"設立\d+年", r"安定(した|の)(経営|基盤|運営)", r"退職金", r"永年勤続", r"持株会"),
                Points(Total([Number("has_退職金", 0), Number("has_賞与", 0), Number("has_社会保険完備", 0)]), steps=((3, 2),)),
            ],
        ),
        "D3": Score("理念・やりがい訴求", [Points(Texts(_VISION)), Points(Texts(_VISION), most=1)]),
        "D4": Score("職場環境訴求", [Points(Texts(_PLACE)), Points(Texts(_PLACE), most=1)]),
        "D5": Score(
            "利便性訴求",
            [
                _texts(
                    r"電動(自転車|アシスト)", r"スマ(ホ|ートフォン).{0,5}貸与", r"直行直帰", r"ペーパーレス", r"ICT", r"IT.{0,5}(化|活用|導入)", r"(自転車|バイク|車).{0,5}貸与",
                    r"駅.{0,5}(近|チカ|徒歩\d分)", r"電子カルテ", r"タブレット",
                )
            ],
        ),
        "D6": Score(
            "成長・スキルアップ訴求",
            [
                _texts(
                    r"研修.{0,5}(充実|豊富|10|多数)", r"e-?ラーニング", r"キャリアパス.{0,5}(2|3|複数)", r"資格取得.{0,5}(支援|補助|制度)", r"社内認定", r"スキルアップ", r"キャリアアップ",
                    r"成長.{0,5}(できる|環境|実感)",
                ),
                Points(Length("education_training"), steps=((301, 2), (101, 1))),
            ],
        ),
        "D7": Score(
            "条件・待遇訴求",
            [
                Points(Number("benefits_score", 0), steps=((19, 3), (14, 2), (9, 1))),
                _texts(r"福利厚生.{0,5}充実", r"待遇.{0,5}充実", r"手当.{0,5}充実", r"ベネフィットステーション", r"リロクラブ"),
            ],
        ),
    },
    "E": {
        "E1": Score(
            "緊急大量採用",
            [
                _texts(r"お祝い金", r"入社祝", per=2), _tag("即日勤務OK"), _tag("未経験可"), _tag("学歴不問"), _tag("フリーターOK"), _tag("主夫・主婦OK"),
                _texts(r"面(接|談)\s*(1|１)\s*回"), _tag("オープン3年以内"),
            ],
        ),
        "E2": Score(
            "積極採用",
            [
                Points(Tags(["未経験可", "ブランク可", "40代活躍", "50代活躍"]), steps=((3, 2), (2, 1))), Points(_CONTENT, steps=((9, 2), (6, 1))), Points(TagCount(), steps=((20, 1),)),
                Points(Length("job_description"), steps=((500, 1),)), _texts(r"動画", r"インタビュー", r"スタッフの声", r"先輩社員"), _texts(r"(複数|[2-9])\s*名?\s*(募集|採用|枠)", r"増員"),
            ],
        ),
        "E3": Score("通常採用", [Points(Between(_CONTENT, 4, 6)), Points(Between(Length("job_description"), 100, 499)), Points(Between(TagCount(), 6, 14))], base=3),
        "E4": Score(
            "厳選採用",
            [
                Points(_YEARS, steps=((3, 2),)), _texts(r"面(接|談)\s*(2|２|3|３)\s*回", r"適性検査", r"書類選考", r"筆記試験"), _tag("未経験可", -1),
                _is(_QUALIFIED, 2, "経験者・資格必須"),
            ],
            base=1,
        ),
        "E5": Score(
            "静かな募集",
            [
                Points(
                    Total(
                        [
                            Between(_CONTENT, -999, 2), Between(TagCount(), 0, 3), Between(Length("job_description"), 0, 49), Between(Length("benefits"), 0, 19),
                            Between(Texts([r"アットホーム", r"風通し", r"チームワーク", r"やりがい", r"成長", r"充実", r"安心", r"地域密着", r"理念"]), 0, 0),
                        ]
                    ),
                    steps=((4, 4), (3, 2), (2, 1)),
                )
            ],
        ),
    },
}

# -- fixed values: kinds

KINDS = [
    Kind("FRESH_CAREER", {"A": ["A1", "A2"], "B": ["B1", "B2"], "C": ["C1"], "D": ["D6"]}, ("新卒・未経験から成長できるキャリア型ポジション", "未経験×若手×キャリア成長", "成長環境を重視する若手の未経験者向け求人")),
    Kind("FRESH_EASY", {"A": ["A1"], "B": ["B1", "B2"], "E": ["E1"]}, ("若手の未経験を大量に採用したいポジション", "未経験×若手×緊急大量採用", "未経験の若手を大量採用中の求人")),
    Kind("YOUNG_SKILLED", {"A": ["A2"], "B": ["B2"], "D": ["D6"]}, ("資格を活かしてステップアップしたい若手向け", "資格有×若手×成長", "資格保有の若手がスキルアップを狙える求人")),
    Kind("YOUNG_INCOME", {"A": ["A4"], "B": ["B2"], "D": ["D1"]}, ("経験ある若手が年収アップを狙えるポジション", "即戦力×若手×高収入", "即戦力の若手向け高収入求人")),
    Kind("MAMA_WLB", {"A": ["A5", "A1", "A2"], "C": ["C3"], "D": ["D4"]}, ("子育て中の方が安心して復帰できる職場", "復職・未経験×子育て×環境重視", "子育て中の復職者向けの温かい職場環境の求人")),
    Kind("MAMA_PART", {"C": ["C4", "C3"], "D": ["D4"]}, ("子育てママのスキマ時間パート", "短時間×子育て×環境重視", "子育て中の方向け短時間パート")),
    Kind("SENIOR_STABLE", {"A": ["A3", "A4"], "B": ["B4"], "C": ["C5"]}, ("シニアが経験を活かして長く働ける安定職場", "経験者×シニア×安定長期", "シニア経験者が安定して長期就業できる求人")),
    Kind("SENIOR_EASY", {"A": ["A1", "A2"], "B": ["B4"], "E": ["E1", "E2"]}, ("シニア未経験OK！人手不足で積極募集", "未経験×シニア×積極採用", "シニアの未経験者も歓迎する積極採用求人")),
    Kind("MID_EXPERT", {"A": ["A4"], "B": ["B3"], "D": ["D2"]}, ("ミドル世代の即戦力を安定企業が求める", "即戦力×ミドル×安定企業", "ミドル世代の即戦力向け安定企業の求人")),
    Kind("MID_LEADER", {"A": ["A4"], "B": ["B3"], "D": ["D6"]}, ("管理職・リーダー候補のミドル採用", "即戦力×ミドル×管理職候補", "ミドル世代の管理職候補を求める求人"), ["管理職", "リーダー", "マネージャー", "主任", "施設長"]),
    Kind("RETURN_SAFE", {"A": ["A5"], "C": ["C2"], "D": ["D4"]}, ("ブランク明けでも安心のWLB重視職場", "復職×WLB×環境重視", "復職者がWLB重視で安心して働ける求人")),
    Kind("RETURN_CAREER", {"A": ["A5"], "C": ["C1"], "D": ["D3"]}, ("やりがいを持って現場復帰したい経験者向け", "復職×キャリア×理念共感", "理念に共感する復職経験者向けの求人")),
    Kind("DUAL_WORK", {"C": ["C4"], "D": ["D1"]}, ("副業・Wワークでしっかり稼ぎたい方向け", "Wワーク×収入重視", "Wワーク・副業で収入を増やしたい方向けの求人")),
    Kind("FREETER_START", {"A": ["A1"], "C": ["C4"], "E": ["E1", "E2"]}, ("フリーターから正社員を目指せる入口", "未経験×フリーター×積極採用", "フリーターの正社員化を支援する求人")),
    Kind("VISION_YOUNG", {"A": ["A1", "A2"], "B": ["B2"], "D": ["D3"]}, ("理念に共感する若手を育てたい事業所", "未経験×若手×理念共感", "理念重視で若手を育成する事業所の求人")),
    Kind("VISION_EXPERT", {"A": ["A4"], "D": ["D3", "D6"]}, ("経験者がやりがいを持って長期成長できる環境", "即戦力×理念×成長", "経験者が理念を持って成長し続けられる求人")),
    Kind("MASS_HIRE", {"E": ["E1"], "A": ["A1"]}, ("大規模オープニング緊急大量採用", "未経験×緊急大量×お祝い金", "お祝い金付きの大量緊急採用求人"), [r"お祝い金.{0,10}\d{2}万"]),
    Kind("QUIET_POST", {"E": ["E5"]}, ("最低限の掲載で静かに欠員補充", "簡素掲載×欠員補充", "控えめな掲載の欠員補充型求人")),
    Kind("PREMIUM_PKG", {"D": ["D7"]}, ("業界トップクラスの待遇パッケージ", "超充実待遇", "福利厚生・待遇が非常に充実した求人")),
    Kind("IT_MODERN", {"D": ["D5"]}, ("IT活用で効率的に働ける現代型職場", "IT・利便性重視", "ICT活用で効率的な働き方ができる求人")),
    Kind("WLB_FRESH", {"A": ["A1"], "B": ["B1", "B5"], "C": ["C2"], "D": ["D1", "D2", "D6"]}, ("未経験から始めるWLB重視の職場", "未経験×WLB重視", "未経験歓迎でワークライフバランスを重視する求人")),
    Kind("CAREER_FRESH", {"A": ["A1"], "B": ["B1", "B5"], "C": ["C1"], "D": ["D1", "D2"]}, ("未経験から正社員キャリアを築ける職場", "未経験×正社員キャリア", "未経験から正社員としてキャリアを築ける求人")),
    Kind("MAMA_FRESH", {"A": ["A1", "A2"], "C": ["C3"], "D": ["D1", "D2", "D6"]}, ("未経験ママが子育てしながら始められる職場", "未経験×子育て両立", "未経験で子育て中の方が始めやすい求人")),
    Kind("WLB_ANYONE", {"A": ["A1", "A5"], "B": ["B5"], "C": ["C2"]}, ("年齢不問でWLB重視の働きやすい職場", "年齢不問×WLB重視", "年齢を問わずWLBを重視できる求人")),
    Kind("RETURN_CAREER_YOUNG", {"A": ["A5"], "B": ["B1", "B2"], "C": ["C1"]}, ("ブランクから若手としてキャリア再構築できる職場", "復職×若手×キャリア再構築", "若手の復職者がキャリアを再構築できる求人")),
    Kind("RETURN_WLB_WIDE", {"A": ["A5"], "B": ["B5"], "C": ["C2"]}, ("ブランク復帰で年齢不問×ゆったり勤務の職場", "復職×年齢不問×WLB", "ブランク明けの方が年齢を問わずWLB重視で働ける求人")),
    Kind("RETURN_MID_CAREER", {"A": ["A5"], "B": ["B3"], "C": ["C1"]}, ("ミドルのブランク明けがキャリア復帰できる職場", "復職×ミドル×キャリア復帰", "ミドル世代の復職者がキャリア復帰できる求人")),
    Kind("RETURN_CAREER_WIDE", {"A": ["A5"], "B": ["B5"], "C": ["C1"]}, ("ブランクから幅広い年齢でキャリア復帰", "復職×年齢不問×キャリア", "ブランク明けの方が年齢不問でキャリア復帰できる求人")),
    Kind("RETURN_WLB_YOUNG", {"A": ["A5"], "B": ["B1", "B2"], "C": ["C2"]}, ("若手復帰者がWLBを重視して再スタートできる職場", "復職×若手×WLB再スタート", "若手の復職者がWLB重視で再スタートできる求人")),
    Kind("RETURN_MID_WLB", {"A": ["A5"], "B": ["B3"], "C": ["C2"]}, ("ミドル復帰者がゆったりペースで復帰できる職場", "復職×ミドル×WLB", "ミドル世代の復職者がWLB重視で働ける求人")),
    Kind("SENIOR_RETURN_CAREER", {"A": ["A5"], "B": ["B4"], "C": ["C1"]}, ("シニア復帰者が経験を活かしてキャリア継続", "復職×シニア×キャリア", "シニア世代の復職者がキャリアを活かせる求人")),
    Kind("CAREER_ANYONE", {"A": ["A1"], "B": ["B5"], "C": ["C1"]}, ("年齢不問でキャリア志向の未経験歓迎職場", "未経験×年齢不問×キャリア", "年齢不問で未経験からキャリアを築ける求人")),
    Kind("SENIOR_RETURN_WLB", {"A": ["A5"], "B": ["B4"], "C": ["C2"]}, ("シニア復帰者がゆったりペースで働ける職場", "復職×シニア×WLB", "シニア世代の復職者がWLB重視で働ける求人")),
    Kind("CERT_CAREER", {"A": ["A2"], "B": ["B1", "B2", "B5"], "C": ["C1"]}, ("資格を活かして未経験からキャリア開始", "資格有×未経験×キャリア開始", "資格保有者が未経験からキャリアを始められる求人")),
    Kind("FRESH_STABLE", {"A": ["A1"], "B": ["B1", "B5"], "C": ["C5"]}, ("未経験から安定企業で長期就業できる職場", "未経験×安定長期", "未経験歓迎の安定企業で長期就業できる求人")),
    Kind("MAMA_MID_RETURN", {"A": ["A5"], "B": ["B3"], "C": ["C3"]}, ("子育て中ミドルのブランク復帰を支援する職場", "復職×ミドル×子育て両立", "子育て中のミドル世代が復帰しやすい求人")),
    Kind("MID_FRESH_CAREER", {"A": ["A1"], "B": ["B3"], "C": ["C1"]}, ("ミドル未経験からのキャリア挑戦を歓迎する職場", "未経験×ミドル×キャリア挑戦", "ミドル世代の未経験者がキャリアを始められる求人")),
    Kind("MID_FRESH_WLB", {"A": ["A1"], "B": ["B3"], "C": ["C2"]}, ("ミドル未経験がWLB重視で新しい分野に挑戦", "未経験×ミドル×WLB", "ミドル世代の未経験者がWLB重視で働ける求人")),
    Kind("SENIOR_RETURN_PART", {"A": ["A5"], "B": ["B4"], "C": ["C4"]}, ("シニア復帰者の短時間・Wワーク", "復職×シニア×短時間", "シニア世代の復職者が短時間で働ける求人")),
    Kind("RETURN_MAMA_WIDE", {"A": ["A5"], "B": ["B5"], "C": ["C3"]}, ("年齢不問で復帰する子育て中の方向け", "復職×年齢不問×子育て", "子育て中の復職者が年齢不問で働ける求人")),
    Kind("SENIOR_MAMA_RETURN", {"A": ["A5"], "B": ["B4"], "C": ["C3"]}, ("シニアで子育て中の方の復帰を支援する職場", "復職×シニア×子育て", "子育て中のシニア世代が復帰しやすい求人")),
    Kind("FRESH_WLB_CAREER", {"A": ["A1"], "B": ["B2"], "C": ["C2"]}, ("未経験の若手がWLB重視で成長できる職場", "未経験×若手×WLB", "未経験の若手がWLBを重視しながら成長できる求人")),
    Kind("MID_CAREER_WLB", {"A": ["A4"], "B": ["B3"], "C": ["C2"]}, ("即戦力ミドルがWLB重視で活躍できる職場", "即戦力×ミドル×WLB", "即戦力のミドル世代がWLB重視で活躍できる求人")),
    Kind("ANYONE_STABLE_CAREER", {"A": ["A1", "A2"], "B": ["B5"], "C": ["C5"]}, ("年齢不問で未経験から安定長期就業できる職場", "未経験×年齢不問×安定長期", "年齢不問で未経験者が安定して長く働ける求人")),
    Kind("EXPERT_INCOME_WLB", {"A": ["A4"], "D": ["D1"], "C": ["C2"]}, ("即戦力が高収入とWLBを両立できるポジション", "即戦力×高収入×WLB", "即戦力の経験者が高収入でWLBも実現できる求人")),
    Kind("MID_STABLE_ENV", {"A": ["A4"], "B": ["B3"], "D": ["D4"]}, ("即戦力ミドルが職場環境を重視して活躍できる職場", "即戦力×ミドル×環境重視", "即戦力のミドル世代向けの環境重視型求人")),
    Kind("FRESH_MAMA_WLB", {"A": ["A1", "A2"], "C": ["C3"], "D": ["D4", "D7"]}, ("未経験ママがWLB重視で子育てしながら働ける職場", "未経験×子育て×環境・待遇重視", "未経験の子育て中の方が環境・待遇重視で働ける求人")),
]
