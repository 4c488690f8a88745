"""Dictionaries for Japanese job adverts; every operator takes others of the same shape."""

# Tags that stand in a text as they are.
TAGS = [
    "未経験可", "無資格可", "資格不問", "学歴不問", "新卒可", "ブランク可", "復職支援", "40代活躍", "50代活躍", "60代活躍", "年齢不問", "主夫・主婦OK", "フリーターOK",
    "副業OK", "WワークOK", "日勤のみ可", "夜勤専従", "残業ほぼなし", "残業なし", "4週8休以上", "土日祝休み", "即日勤務OK", "オープン3年以内", "退職金あり", "資格取得支援",
    "研修制度あり", "育児支援あり", "家庭都合休OK", "テレワーク可", "フレックスタイム", "転勤なし", "駅近", "オープニング", "高給与", "正社員登用あり", "Web面接可", "産休育休実績あり",
    "有給取得率高", "見学可", "ICT活用", "完全週休2日", "土日休み", "20代活躍", "30代活躍", "週休3日", "扶養内OK",
]

# Other wordings of a tag.
TAG_SYNONYMS = {
    "未経験可": ["経験不問", "未経験OK", "未経験ok", "未経験歓迎", "未経験者歓迎"],
    "無資格可": ["資格なしOK", "無資格OK"],
    "ブランク可": ["ブランクOK", "ブランクok"],
    "主夫・主婦OK": ["主婦OK", "主夫OK", "主婦歓迎", "主夫歓迎", "主夫・主婦OK"],
    "フリーターOK": ["フリーター歓迎"],
    "WワークOK": ["ダブルワークOK", "Wワーク可"],
    "副業OK": ["副業可"],
    "残業ほぼなし": ["残業少なめ", "残業月10時間以内"],
    "退職金あり": ["退職金制度"],
    "育児支援あり": ["育児支援", "託児所あり"],
    "テレワーク可": ["リモートワーク可", "在宅勤務可", "在宅勤務OK"],
    "フレックスタイム": ["フレックス制", "時差出勤"],
    "転勤なし": ["転勤無し", "転勤ありません"],
    "駅近": ["駅チカ", "駅前", "駅直結"],
    "オープニング": ["オープニングスタッフ", "新規オープン"],
    "高給与": ["高収入", "高年収", "高時給"],
    "正社員登用あり": ["正社員登用制度", "社員登用あり"],
    "Web面接可": ["オンライン面接", "リモート面接", "Zoom面接"],
    "産休育休実績あり": ["育休取得実績", "産休実績あり"],
    "有給取得率高": ["有給消化率高"],
    "見学可": ["職場見学OK", "見学歓迎", "見学会"],
    "ICT活用": ["ICT導入", "DX推進"],
    "完全週休2日": ["完全週休二日", "完全週休2日制"],
    "土日休み": ["土日お休み", "土日祝お休み", "土日祝休み"],
    "20代活躍": ["20代活躍中", "20代が活躍"],
    "30代活躍": ["30代活躍中", "30代が活躍"],
}

# Patterns that also mean a tag.
TAG_PATTERNS = {
    "テレワーク可": r"テレワーク|リモート(ワーク|勤務)|在宅(勤務|ワーク)",
    "高給与": r"高(給|収入|年収|時給)|業界(最高|トップ|高水準)",
    "Web面接可": r"(Web|オンライン|リモート|Zoom|ウェブ)\s*(面接|面談)",
    "フレックスタイム": r"フレックス(タイム)?制?|時差出勤",
    "駅近": r"駅.{0,3}(近|チカ|前|直結)|駅.{0,5}徒歩[1-5]分",
    "オープニング": r"オープニング|新規オープン|新設.{0,3}(施設|事業所)",
    "正社員登用あり": r"正社員(登用|への|切替|転換)",
    "産休育休実績あり": r"産(休|前産後).{0,10}(実績|取得)|育休.{0,5}(実績|取得率|復帰)",
    "有給取得率高": r"有給.{0,5}(取得率|消化率).{0,5}(高|[7-9]\d%|100%)",
    "見学可": r"(職場)?(見学|体験).{0,5}(可|OK|歓迎|受付)",
    "ICT活用": r"ICT|DX|IT.{0,5}(化|活用|導入)|電子カルテ|ペーパーレス",
    "扶養内OK": r"扶養(内|範囲|控除).{0,3}(OK|可|内|勤務)",
    "週休3日": r"週休3日|週休三日",
}

# Benefit flags and their patterns.
BENEFITS = {
    "has_社会保険完備": r"社会保険完備|社保完備",
    "has_賞与": r"賞与|ボーナス",
    "has_交通費支給": r"交通費(支給|全額)|通勤手当",
    "has_退職金": r"退職金",
    "has_住宅手当": r"住宅手当|住居手当|家賃補助",
    "has_資格手当": r"資格手当",
    "has_夜勤手当": r"夜勤手当",
    "has_資格取得支援": r"資格取得(支援|補助|助成|制度)",
    "has_研修制度": r"研修(制度|充実|あり)",
    "has_育児支援": r"育児(支援|休暇|休業)|託児|保育",
    "has_車通勤可": r"車通勤(可|OK)|マイカー(通勤)?可",
    "has_制服貸与": r"制服(貸与|あり|支給)",
    "has_食事補助": r"食事補助|社員食堂",
    "has_健康診断": r"(健康|定期)診断",
    "has_インフルエンザ補助": r"インフルエンザ.{0,3}(補助|予防接種)",
    "has_お祝い金": r"お祝い金|入社祝",
    "has_永年勤続": r"永年勤続",
    "has_持株会": r"持株会",
    "has_福利厚生サービス": r"ベネフィットステーション|リロクラブ|福利厚生サービス",
    "has_テレワーク": r"テレワーク|リモートワーク|在宅勤務",
    "has_フレックス": r"フレックス(タイム)?|時差出勤",
    "has_残業文化なし": r"残業(ほぼ|ほとんど)?なし|残業.{0,3}ゼロ|定時(退社|帰り)",
    "has_社員割引": r"社員割引|従業員割引|職員割引",
    "has_配偶者手当": r"配偶者手当|扶養手当",
    "has_子ども手当": r"子ども手当|家族手当|子供手当",
}

# Holiday patterns, first match wins; the lower ones apply where none of the upper does.
HOLIDAYS = (
    ("完全週休2日", r"完全週休2日"),
    ("4週8休", r"4週[89]休"),
    ("週休2日", r"週休2日"),
    ("土日祝休", r"土日祝(休|日)"),
    ("日曜固定休", r"日曜(日)?(.{0,2})(休|固定)"),
    ("シフト制", r"シフト制"),
    ("4週8休", r"月(?:[89]\d?|10)\s*日?(以上)?\s*(の?\s*)?休"),
    ("シフト制", r"月[67]\s*日?(以上)?\s*(の?\s*)?休"),
    ("4週8休", r"[34]勤[12]休"),
    ("シフト制", r"シフトによる|ローテーション"),
    ("パート応相談", r"週[1-3]日.{0,5}(OK|可|勤務|から)|応相談"),
)

# Shift types that a text names, first match wins; day work only holds where no night work is named.
SHIFTS = (
    ("夜勤専従", r"夜勤専従"),
    ("3交替", r"[3三]交[替代]"),
    ("2交替", r"[2二]交[替代]"),
    ("日勤のみ", r"日勤\s*の\s*み"),
    ("シフト制", r"シフト制"),
)

# Standard employment types and their wordings.
EMPLOYMENT_ALIASES = {
    "正職員": ("正職員", "正社員", "常勤"),
    "パート・バイト": ("パート・バイト", "パート", "バイト", "アルバイト", "非常勤"),
    "契約職員": ("契約職員", "契約社員"),
    "業務委託": ("業務委託",),
    "派遣": ("派遣",),
}

# Categories of work in a job description and their patterns; the first found is the primary task.
CONTENT = {
    "直接介護・看護": (
        r"身体介護", r"入浴(介助|支援)", r"食事(介助|支援)", r"排(せつ|泄)(介助|支援)", r"バイタル(サイン|チェック|測定)?", r"点滴", r"採血", r"注射", r"褥瘡", r"服薬(管理|指導|介助)",
        r"看護業務", r"看護師業務", r"訪問看護", r"訪問入浴", r"医療処置", r"医療行為", r"健康(管理|観察|チェック)", r"透析", r"穿刺", r"返血", r"シャント", r"配薬", r"与薬", r"吸引", r"経管栄養",
        r"創傷(処置|ケア)", r"ストーマ", r"カテーテル", r"血糖(測定|チェック)", r"インスリン",
    ),
    "間接業務": (r"記録(業務|作成)", r"書類(作成|業務)", r"事務(作業|業務)", r"電話対応", r"レセプト", r"請求(業務|事務)", r"データ入力", r"受付(業務)?", r"予約(管理|受付)", r"在庫管理", r"物品(管理|発注)"),
    "相談支援": (r"相談(支援|業務|対応)", r"ケアマネジメント", r"ケアプラン", r"アセスメント", r"退院(支援|調整)", r"生活相談", r"サービス(担当者会議|調整)"),
    "リハビリ": (r"リハビリ(テーション)?", r"機能(訓練|回復)", r"理学療法", r"作業療法", r"言語(聴覚|療法)", r"ADL"),
    "マネジメント": (r"(スタッフ|職員).{0,3}(管理|マネジメント|指導)", r"シフト(管理|作成)", r"人(事|材)(管理|育成)", r"施設(運営|管理)", r"管理(業務|者)"),
    "保育": (r"保育(業務|活動)", r"(乳児|幼児).{0,3}(クラス|担当)", r"お散歩", r"制作活動", r"連絡帳", r"園児"),
    "調理": (r"調理(業務|補助)?", r"配(膳|食)", r"厨房", r"栄養(管理|指導)"),
    "健診・検診": (r"健(康)?診(業務)?", r"検診", r"人間ドック", r"心電図", r"視力検査", r"聴力検査", r"問診", r"保健指導"),
    "美容・自費診療": (r"美容(施術|カウンセリング|注射|外来|皮膚)", r"脱毛", r"アートメイク", r"ヒアルロン酸", r"ボトックス", r"レーザー(治療|施術)", r"点滴(バー|ルーム)"),
    "産業保健": (r"産業(保健|看護)", r"健康(経営|管理室)", r"ストレスチェック", r"衛生(管理|委員会)", r"メンタルヘルス", r"復職支援"),
}

# Marks of a tone.
TONES = {
    "casual": (r"♪", r"！{2,}", r"☆", r"★", r"ぜひ", r"一緒に", r"お気軽に"),
    "urgent": (r"急募", r"至急", r"すぐ(に|働)", r"今すぐ", r"欠員"),
    "formal": (r"つきましては", r"ご応募", r"お問い合わせ", r"下記のとおり"),
}

# Patterns that speak to people of a decade.
AGE_DECADES = {
    "20代": (
        r"髪(色|型).{0,3}(自由|OK)", r"ネイル.{0,3}(自由|OK)", r"ピアス.{0,3}(自由|OK)", r"服装.{0,3}自由", r"プライベート.{0,3}充実", r"第二新卒", r"新卒.{0,3}(歓迎|可|OK)", r"20代.{0,3}(活躍|中心|多い)",
        r"若手.{0,3}(活躍|中心|多い|歓迎)", r"フリーター.{0,3}(歓迎|OK|可)", r"友達.{0,3}(応募|と一緒)", r"SNS", r"平均年齢.{0,3}2\d歳",
    ),
    "30代": (
        r"家庭.{0,5}(両立|と両立)", r"子育て.{0,5}(しながら|中の方|ママ|世代)", r"30代.{0,3}(活躍|中心|多い)", r"ブランク.{0,3}(OK|可|歓迎|ある方)", r"時短勤務", r"育児.{0,3}(短時間|休暇|支援)", r"産休.{0,3}育休",
        r"ワークライフバランス", r"家庭都合.{0,3}休", r"ママ.{0,3}(さん|歓迎|活躍|多い)", r"主婦.{0,3}(歓迎|活躍|パート)", r"平均年齢.{0,3}3\d歳", r"保育(所|園).{0,5}(あり|完備|利用)", r"託児(所|施設)",
    ),
    "40代": (
        r"40代.{0,3}(活躍|中心|多い)", r"経験.{0,3}(活かせる|を活かし)", r"管理職", r"主任", r"リーダー", r"中堅", r"即戦力", r"経験者.{0,3}(優遇|歓迎|求む)", r"キャリアアップ", r"スキルアップ", r"昇進", r"平均年齢.{0,3}4\d歳",
    ),
    "50代": (
        r"50代.{0,3}(活躍|中心|多い|歓迎)", r"シニア.{0,3}(活躍|歓迎|層)", r"定年.{0,3}(後|再雇用)", r"再雇用", r"経験豊富", r"ベテラン.{0,3}(歓迎|活躍|多い)", r"熟練", r"長年.{0,3}(経験|実績)", r"平均年齢.{0,3}5\d歳",
    ),
    "60代": (r"60代.{0,3}(活躍|中心|多い|歓迎)", r"生涯現役", r"シニア.{0,3}歓迎", r"定年.{0,3}(なし|65歳|70歳|延長)", r"エイジレス", r"年齢.{0,3}(不問|上限なし)", r"高齢者.{0,3}(歓迎|活躍)"),
}

# Patterns that lean to a gender.
GENDER_SIGNALS = {
    "female": (
        r"女性.{0,3}(活躍|多い|中心|歓迎|スタッフ|が多|の方)", r"ママ.{0,3}(さん|歓迎|活躍|多い|ナース)", r"主婦.{0,3}(歓迎|活躍|パート|の方)", r"ネイル.{0,3}(自由|OK)", r"髪(色|型).{0,3}(自由|OK)", r"産(前|後|休)",
        r"育休", r"マタニティ", r"託児", r"保育(所|園).{0,5}(あり|完備|利用)", r"女性管理職",
    ),
    "male": (r"男性.{0,3}(活躍|多い|中心|歓迎|スタッフ)", r"力仕事", r"体力.{0,3}(必要|ある方|に自信)", r"男性管理職"),
}

# Stages of a working life in their order, and the patterns that name them.
LIFE_STAGES = {
    "新卒・キャリア初期": (r"新卒", r"第二新卒", r"未経験.{0,3}(歓迎|可|OK).{0,10}若手", r"社会人.{0,3}(1|2|3)年", r"入社.{0,3}(1|2|3)年"),
    "キャリア形成期": (r"スキルアップ", r"キャリアアップ", r"正社員登用", r"資格取得.{0,5}(支援|費用|補助)", r"昇進", r"研修.{0,5}(充実|制度)", r"等級.{0,3}制度"),
    "結婚・出産期": (r"産(前|後|休)", r"育(休|児休)", r"産前産後", r"出産.{0,3}(祝|手当|休)", r"マタニティ", r"結婚.{0,3}(祝|手当|休)"),
    "育児期": (r"時短勤務", r"託児(所|施設)", r"保育(所|園).{0,5}(あり|完備|利用)", r"子.{0,2}(ども|供).{0,3}(手当|看護)", r"家庭.{0,5}(両立|と両立)", r"子育て", r"ママ.{0,3}(さん|歓迎|活躍)", r"学校行事.{0,3}(参加|休)", r"急な.{0,5}(休|対応)", r"扶養内"),
    "復職期": (r"ブランク.{0,3}(OK|可|歓迎|ある方)", r"復職.{0,3}(支援|歓迎|OK)", r"再就職", r"主婦.{0,3}(歓迎|活躍|パート)", r"久しぶり.{0,5}(仕事|復帰)", r"現場復帰"),
    "セカンドキャリア期": (r"管理職", r"主任", r"リーダー", r"経験.{0,3}(活かせる|を活かし)", r"キャリア.{0,3}チェンジ", r"転職.{0,3}(歓迎|支援)"),
    "介護離職・復帰期": (r"介護休(暇|業)", r"家族.{0,3}介護", r"家庭都合.{0,3}休", r"短時間.{0,3}(勤務|パート)", r"柔軟.{0,5}(勤務|シフト|働)"),
}

# What counts as a national licence, by policy.
NATIONAL_LICENCES = {
    "exact": ("看護師", "准看護師", "保健師", "助産師", "理学療法士", "作業療法士"),
    "master": ("看護師", "准看護師", "保健師", "助産師", "理学療法士", "作業療法士", "介護福祉士", "社会福祉士", "精神保健福祉士", "保育士", "栄養士", "管理栄養士"),
    "part": (
        "介護福祉士", "看護師", "准看護師", "理学療法士", "作業療法士", "言語聴覚士", "社会福祉士", "精神保健福祉士", "管理栄養士", "栄養士", "保健師", "助産師", "薬剤師", "歯科衛生士", "歯科技工士",
        "臨床検査技師", "診療放射線技師", "臨床工学技士", "義肢装具士", "あん摩マッサージ指圧師", "はり師", "きゅう師", "柔道整復師", "視能訓練士", "救急救命士",
    ),
    "wide part": ("国家", "看護師", "介護福祉士", "保育士", "薬剤師", "医師", "理学療法士", "作業療法士"),
}
