"""Codes used in results and the labels a reader sees (fixed values)."""

from __future__ import annotations

# Analytic variable types.
TYPE_LABELS = {
    "excluded": "제외 변수",
    "date": "날짜형 변수",
    "id": "ID성 변수",
    "numeric_categorical": "숫자형 범주 변수",
    "numeric": "수치형 변수",
    "categorical": "범주형 변수",
    "other": "기타 변수",
}

# Short type labels of the per-column report.
SHORT_TYPE_LABELS = {
    "numeric": "수치형",
    "date": "날짜형",
    "categorical": "범주형",
    "numeric_categorical": "범주형(숫자코딩)",
    "id": "ID성",
    "other": "기타",
    "excluded": "기타",
}

# Quality items, in report order.
ITEM_LABELS = {
    "missing": "결측치 품질",
    "type_format": "자료형·형식 및 특수값 일관성",
    "duplicate": "중복값 품질",
    "outlier": "이상치 품질",
    "structure": "변수 구조 품질",
    "categorical": "범주형 변수 품질",
    "basic": "데이터 기본 구조 및 변수명 품질",
}

STATUS_LABELS = {"good": "양호", "caution": "주의", "danger": "위험"}
GRADE_LABELS = {"excellent": "우수", "good": "양호", "caution": "주의", "unfit": "부적합"}
FIT_LABELS = {"fit": "적합", "partly": "부분 적합", "unfit": "부적합", "unselected": "미선택"}
FIT_COLORS = {"fit": "success", "partly": "warning", "unfit": "danger"}

PURPOSE_LABELS = {
    "basic_stats": "기초 통계 분석",
    "visualization": "시각화/EDA",
    "advanced_ml": "통계적 검정 / 가설 검정",
    "correlation": "상관분석",
    "regression": "회귀분석",
    "classification": "분류분석",
    "cluster": "군집분석",
    "time_series": "시계열분석",
    "dimension": "차원축소/다변량 구조 분석",
    "survival": "생존분석",
}
