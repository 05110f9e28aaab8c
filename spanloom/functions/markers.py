"""Phrases that place a sentence in a commercial, and the patterns of figures and prices."""

PROBLEM_MARKERS = (
    "困擾", "麻煩", "問題", "煩", "受不了", "不方便", "不好用", "難", "痛", "怕", "擔心",
    "浪費", "每次", "總是", "老是", "常常", "是不是", "有沒有", "你是否",
    "缺點", "缺陷", "痛點", "卡住", "卡卡", "太慢", "很慢", "不順", "費力", "吃力", "費時",
    "弄髒", "打翻", "翻倒", "壞掉", "抱怨",
    "tired of", "problem", "struggle", "annoying", "hate",
)
PRODUCT_MARKERS = (
    "這款", "這個產品", "這支", "這台", "這組", "這瓶", "這件", "這套", "我們的", "功能",
    "設計", "材質", "尺寸", "用法", "使用方式", "安裝", "一鍵", "開箱", "介紹", "推出", "新品",
    "introducing", "feature", "design", "made of",
)
PROOF_MARKERS = (
    "實測", "測試", "試用", "親身", "用了", "用過", "效果", "結果", "見證", "評價", "好評",
    "回購", "推薦", "數據", "證明", "認證", "比較", "對比", "前後", "滿意", "銷量", "賣出",
    "顧客", "客人", "網友", "百分之",
    "tested", "results", "review", "customers", "proven", "before and after",
)
CTA_MARKERS = (
    "價格", "價錢", "售價", "原價", "特價", "優惠", "折扣", "打折", "限時", "限量", "下單",
    "購買", "買", "連結", "網址", "官網", "留言", "私訊", "訂閱", "追蹤", "按讚", "點擊",
    "趕快", "快去", "搶", "免運", "現在就",
    "link", "buy", "order", "subscribe", "follow", "discount", "code", "shop", "sale",
)
PRODUCT_ON_SCREEN_WORDS = ("產品", "商品", "product")
NUMBER = "[0-9零〇一二兩三四五六七八九十百千萬]+"
PROOF_PATTERNS = (NUMBER + r"\s*(%|％|倍|萬|人|次|天|小時)",)
CTA_PATTERNS = (
    NUMBER + r"\s*(元|塊|块|圓)",
    r"(nt\$|ntd|\$)\s*[0-9]",
    "打" + NUMBER + "折",
    r"[0-9]+\s*折",
)
HOOK_SECONDS, HOOK_MIN_UNITS, NEIGHBOUR_CHARACTERS = 3.0, 4, 6
