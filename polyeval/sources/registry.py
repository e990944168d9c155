"""Dataset registry.

A16: declared schema per dataset configuration; ``conform`` selects and
casts to it (unknown dataset raises). J8: a user registers a dataset with
its schema, a prompt expression, a label map and a scoring variant; the
registry hands back column expressions, so registered datasets run through
the same Spark plan as the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

S = "string"
CHOICES = "struct<text:array<string>,label:array<string>>"

# Declared input schemas (from the inputs the translation and prompt steps read)
SCHEMAS: dict[str, str] = {
    "openbookqa": f"struct<id:{S},question_stem:{S},choices:{CHOICES},answerKey:{S}>",
    "openbookqa_additional": (f"struct<id:{S},question_stem:{S},choices:{CHOICES},answerKey:{S},"
                              f"turkIdAnonymized:{S},fact1:{S},humanScore:double,clarity:double>"),
    "openbookqa_bn": f"struct<id:{S},question_stem:{S},choices_text:{S},choices_label:{S},answerKey:{S}>",
    "arc": f"struct<id:{S},question:{S},choices:{CHOICES},answerKey:{S}>",
    "arc_bn": f"struct<id:{S},question:{S},choices:map<{S},{S}>,answerKey:{S}>",
    "commonsenseqa": f"struct<id:{S},question:{S},question_concept:{S},choices:{CHOICES},answerKey:{S}>",
    "truthfulqa_mc": ("struct<question:string,mc1_targets:struct<choices:array<string>,labels:array<int>>,"
                      "mc2_targets:struct<choices:array<string>,labels:array<int>>>"),
    "truthfulqa_gen": (f"struct<type:{S},category:{S},question:{S},best_answer:{S},"
                       f"correct_answers:array<{S}>,incorrect_answers:array<{S}>,source:{S}>"),
    "mmlu": f"struct<prompt:{S},A:{S},B:{S},C:{S},D:{S},answer:{S}>",
    "mmlu_pro": (f"struct<question_id:bigint,question:{S},options:array<{S}>,answer:{S},answer_index:bigint,"
                 f"cot_content:{S},category:{S},src:{S}>"),
    "agieval": f"struct<passage:{S},question:{S},options:array<{S}>,label:{S},answer:{S},other:struct<solution:{S}>>",
    "bbh": f"struct<input:{S},target:{S}>",
    "boolq": f"struct<question:{S},title:{S},answer:boolean,passage:{S}>",
    "gsm8k": f"struct<question:{S},answer:{S}>",
    "mr_gsm8k": (f"struct<uuid:{S},question:{S},ground_truth_solution:{S},ground_truth_answer:{S},"
                 f"model_output_steps:array<{S}>,model_output_answer_correctness:{S},"
                 f"model_output_solution_correctness:{S},model_output_solution_first_error_step:{S},"
                 f"model_output_solution_first_error_reason:{S},question_type:{S}>"),
    "mr_gsm8k_training": f"struct<query:{S},response:{S}>",
    "math": f"struct<problem:{S},level:{S},type:{S},solution:{S}>",
    "hellaswag": (f"struct<ind:bigint,activity_label:{S},ctx_a:{S},ctx_b:{S},ctx:{S},split:{S},"
                  f"split_type:{S},label:{S},endings:array<{S}>,source_id:{S}>"),
    "winogrande": f"struct<qID:{S},sentence:{S},option1:{S},option2:{S},answer:{S}>",
    "piqa": f"struct<goal:{S},sol1:{S},sol2:{S},label:bigint>",
    "siqa": f"struct<context:{S},question:{S},answerA:{S},answerB:{S},answerC:{S}>",
    "preference_pairs": f"struct<chosen:{S},rejected:{S}>",
    "red_team": (f"struct<transcript:{S},task_description:{S},min_harmlessness_score_transcript:double,"
                 f"num_params:{S},model_type:{S},rating:double,task_descripton_harmlessness_score:double,"
                 f"red_team_member_id:bigint,is_upworker:boolean,tags:array<{S}>>"),
    "alpaca_eval": f"struct<instruction:{S},output:{S},generator:{S},dataset:{S}>",
    "humaneval": f"struct<task_id:{S},prompt:{S},canonical_solution:{S},test:{S},entry_point:{S}>",
    "dolly": f"struct<instruction:{S},context:{S},response:{S},category:{S}>",
    "bfcl": (f"struct<id:{S},question:array<array<struct<role:{S},content:{S}>>>,function:array<{S}>,"
             f"execution_result_type:array<{S}>,ground_truth:array<{S}>>"),
    "responses": (f"struct<question_id:{S},dataset:{S},model:{S},system_prompt:{S},prompt:{S},"
                  f"response:{S},ground_truth:{S}>"),
}


# The task configurations that share the layout of "bbh"
BBH_TASKS = [
    "salient_translation_error_detection", "tracking_shuffled_objects_three_objects", "geometric_shapes",
    "object_counting", "word_sorting", "logical_deduction_five_objects", "hyperbaton", "sports_understanding",
    "logical_deduction_seven_objects", "multistep_arithmetic_two", "ruin_names", "causal_judgement",
    "logical_deduction_three_objects", "formal_fallacies", "snarks", "boolean_expressions",
    "reasoning_about_colored_objects", "dyck_languages", "navigate", "disambiguation_qa", "temporal_sequences",
    "web_of_lies", "tracking_shuffled_objects_five_objects", "penguins_in_a_table", "movie_recommendation",
    "date_understanding",
]
SCHEMAS.update({f"bbh/{task}": SCHEMAS["bbh"] for task in BBH_TASKS})

# The layouts of the preference evaluation's configurations
_COMPARED = f"struct<instruction:{S},output_1:{S},output_2:{S},preference:bigint,annotator_index:bigint,dataset:{S},datasplit:{S}"
_ANNOTATED = (f"struct<instruction:{S},output_1:{S},generator_1:{S},output_2:{S},generator_2:{S},dataset:{S},annotator:{S},"
              f"preference:bigint,price_per_example:float,time_per_example:float>")
SCHEMAS.update({
    "alpaca_eval_gpt4_baseline": SCHEMAS["alpaca_eval"],
    "alpaca_eval_all_outputs": SCHEMAS["alpaca_eval"],
    "alpaca_farm_human_annotations": f"{_COMPARED},generator:{S},sample_mode:{S}>",
    "alpaca_farm_human_crossannotations": f"{_COMPARED}>",
    "alpaca_eval_annotations_claude": _ANNOTATED,
    "alpaca_eval_annotations_alpaca_eval_gpt4": _ANNOTATED,
})


def schema_of(dataset: str) -> str:
    if dataset not in SCHEMAS:
        raise KeyError(f"unknown dataset {dataset!r}; known: {sorted(SCHEMAS)}")
    return SCHEMAS[dataset]


def conform(df: DataFrame, dataset: str) -> DataFrame:
    """The declared columns in declared order and types; a missing
    column becomes null, extra columns are dropped."""
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema_of(dataset))
    cols = []
    have = set(df.columns)
    for f in st.fields:
        c = F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


@dataclass
class DatasetSpec:
    """What a user registers for a dataset."""
    name: str
    schema: str
    prompt: Callable[[str], Column]          # lang -> Column with the rendered prompt
    truth: Callable[[], Column]               # Column with the ground truth
    variant: str = "generic"                  # scoring rule of section 2.3
    labels: dict[str, str] = field(default_factory=dict)


REGISTRY: dict[str, DatasetSpec] = {}


def register_dataset(spec: DatasetSpec) -> None:
    """Add (or replace) a dataset."""
    SCHEMAS[spec.name] = spec.schema
    REGISTRY[spec.name] = spec


def render(df: DataFrame, dataset: str, lang: str) -> DataFrame:
    """Prompts of a registered dataset as (prompt, ground_truth) columns."""
    if dataset not in REGISTRY:
        raise KeyError(f"dataset {dataset!r} is not registered")
    spec = REGISTRY[dataset]
    return df.withColumn("prompt", spec.prompt(lang)).withColumn("ground_truth", spec.truth())
