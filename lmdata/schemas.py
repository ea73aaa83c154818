"""Declared schemas, in DDL, of the records that the operators read and write."""

from __future__ import annotations

RAW_TEXT = "seq bigint, text string"
RAW_JSON = "text string, completion string, content string, sentence string, body string, raw string, title string"
CLEANED = "text string"
CHUNK = "text string, ids array<int>, n_tokens int"
RATIO_REPORT = "ratio string, tokenizer string, seq_length int, overlap int, n_chunks int, total_tokens bigint, domain_tokens bigint, general_tokens bigint, actual_domain_ratio double, target_domain_ratio double"
MESSAGES = "messages array<struct<role: string, content: string>>"
PREFERENCE = "prompt string, chosen string, rejected string"
MCQ_RAW = "Question string, Options array<struct<key: string, value: string>>, Answer string, Explanation string"
MCQ_PROMPT = "prompt string, answer string"
SFT = "prompt string, completion string, question_id int, gold string"
TEACHER_QUESTION = "question_id int, gold string, prompt_raw string, teacher_user_msg string"
TEACHER_ANSWER = "question_id int, gold string, teacher_answer string, teacher_letter string, letter_matches_gold boolean, elapsed_s double, n_out_tokens int"
STUDENT_SAMPLES = "question_id int, gold string, prompt string, samples array<struct<text: string, letter: string, correct: boolean>>"
JUDGE_SCORE = "question_id int, sample_idx int, score int, reason string, elapsed_s double"
ONPOLICY_SFT = "prompt string, completion string, question_id int, gold string, source string"
ONPOLICY_DPO = "prompt string, chosen string, rejected string, question_id int, chosen_score int, rejected_score int"
TEACHER_TOPK = "question_id int, gold string, prompt_len int, completion_token_ids array<int>, positions array<struct<pos: int, topk_tokens: array<int>, topk_logits: array<double>>>"
CPT_LOG = "iter int, kind string, loss double"
DPO_LOG = "step int, epoch double, loss double, `rewards/chosen` double, `rewards/rejected` double, `rewards/margins` double, `rewards/accuracies` double, learning_rate double"
GRPO_LOG = "step int, epoch double, loss double, reward double, reward_std double, kl double, clip_ratio double, learning_rate double"
KD_LOG = "step int, epoch double, loss double, ce double, kl double, grad_norm double, learning_rate double"
MCQ_EVAL = "model string, n int, accuracy double, correct int, unparseable int, unparseable_rate double, max_new_tokens int"
PREDS = "gold string, pred string, gen_head string"
JUDGE_PAIR = "question string, answer_a string, answer_b string, winner string, reason string"
