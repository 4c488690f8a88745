"""Which prefectures border on which, as tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Neighbours of each prefecture, by land, bridge or tunnel.
BORDERS = {
    "北海道": "青森県",
    "青森県": "北海道 岩手県 秋田県",
    "岩手県": "青森県 秋田県 宮城県",
    "宮城県": "岩手県 秋田県 山形県 福島県",
    "秋田県": "青森県 岩手県 宮城県 山形県",
    "山形県": "秋田県 宮城県 福島県 新潟県",
    "福島県": "宮城県 山形県 新潟県 群馬県 栃木県 茨城県",
    "茨城県": "福島県 栃木県 埼玉県 千葉県",
    "栃木県": "福島県 茨城県 群馬県 埼玉県",
    "群馬県": "福島県 新潟県 長野県 埼玉県 栃木県",
    "埼玉県": "群馬県 栃木県 茨城県 千葉県 東京都 山梨県 長野県",
    "千葉県": "茨城県 埼玉県 東京都",
    "東京都": "埼玉県 千葉県 神奈川県 山梨県",
    "神奈川県": "東京都 山梨県 静岡県",
    "新潟県": "山形県 福島県 群馬県 長野県 富山県",
    "富山県": "新潟県 長野県 岐阜県 石川県",
    "石川県": "富山県 岐阜県 福井県",
    "福井県": "石川県 岐阜県 滋賀県 京都府",
    "山梨県": "埼玉県 東京都 神奈川県 長野県 静岡県",
    "長野県": "新潟県 群馬県 埼玉県 山梨県 静岡県 愛知県 岐阜県 富山県",
    "岐阜県": "富山県 石川県 福井県 長野県 愛知県 三重県 滋賀県",
    "静岡県": "神奈川県 山梨県 長野県 愛知県",
    "愛知県": "静岡県 長野県 岐阜県 三重県",
    "三重県": "愛知県 岐阜県 滋賀県 京都府 奈良県 和歌山県",
    "滋賀県": "福井県 岐阜県 三重県 京都府",
    "京都府": "福井県 滋賀県 三重県 奈良県 大阪府 兵庫県",
    "大阪府": "京都府 奈良県 和歌山県 兵庫県",
    "兵庫県": "京都府 大阪府 鳥取県 岡山県 徳島県",
    "奈良県": "三重県 京都府 大阪府 和歌山県",
    "和歌山県": "三重県 奈良県 大阪府",
    "鳥取県": "兵庫県 岡山県 島根県 広島県",
    "島根県": "鳥取県 広島県 山口県",
    "岡山県": "兵庫県 鳥取県 広島県 香川県",
    "広島県": "鳥取県 島根県 岡山県 山口県 愛媛県",
    "山口県": "島根県 広島県 福岡県",
    "徳島県": "兵庫県 香川県 愛媛県 高知県",
    "香川県": "徳島県 愛媛県 岡山県",
    "愛媛県": "徳島県 香川県 高知県 広島県",
    "高知県": "徳島県 愛媛県",
    "福岡県": "山口県 佐賀県 熊本県 大分県",
    "佐賀県": "福岡県 長崎県",
    "長崎県": "佐賀県",
    "熊本県": "福岡県 大分県 宮崎県 鹿児島県",
    "大分県": "福岡県 熊本県 宮崎県",
    "宮崎県": "大分県 熊本県 鹿児島県",
    "鹿児島県": "熊本県 宮崎県",
    "沖縄県": "",
}

# From where the large centres draw people beyond their neighbours.
CATCHMENTS = {
    "東京都": "茨城県 栃木県 群馬県 静岡県 長野県 新潟県",
    "大阪府": "三重県 岡山県 徳島県 香川県 福井県",
    "愛知県": "滋賀県 福井県 石川県 富山県",
    "福岡県": "長崎県 宮崎県 鹿児島県",
    "神奈川県": "静岡県",
    "埼玉県": "茨城県 栃木県 群馬県",
    "千葉県": "茨城県",
    "京都府": "岡山県",
    "兵庫県": "岡山県 香川県",
    "広島県": "香川県",
    "宮城県": "岩手県 福島県 山形県",
}


def pairs(table: dict[str, str]) -> list[tuple[str, str]]:
    """(src, dst): people of src are drawn to dst."""
    return [(src, dst) for dst, near in table.items() for src in near.split()]


def borders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pairs(BORDERS), "src string, dst string")


def catchments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pairs(CATCHMENTS), "src string, dst string")
