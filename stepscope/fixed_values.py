"""Labels, word lists and formats that results must carry unchanged."""

# Report categories, in report order.
CATEGORY_ORDER = [
    "gemm",
    "group gemm",
    "通信 (comm)",
    "FlashAttention (fa)",
    "GDN",
    "Triton",
    "其他elementwise",
    "memcpy/memset",
]
# The six categories every report shows; the other two appear when observed.
DENSE_CATEGORIES = [c for c in CATEGORY_ORDER if c not in ("group gemm", "GDN")]
PLATFORMS = ["auto", "nv", "dcu", "teco"]
RULE_GROUPS = ["common", "nv", "dcu", "teco"]
CONFIDENCES = ["high", "medium", "low", "unknown"]

# Device event categories.
DEVICE_CATEGORIES = [
    "kernel", "gpu_kernel", "cuda_kernel", "hip_kernel", "sdaa_kernel",
    "device_kernel", "gpu_memcpy", "gpu_memset",
]
WINDOW_CATEGORIES = ["kernel", "gpu_memcpy", "gpu_memset"]
HOST_CATEGORIES = ["cpu", "cpu_op", "user_annotation", "python_function"]

# Host operator name parts that count as device work in the phase report (case-sensitive).
PHASE_KEYWORDS = [
    "flash", "Flash", "gemm", "Gemm", "GEMM", "AllReduce", "all_reduce", "nccl", "rccl",
    "triton", "Triton", "ck_", "CK_", "fmha", "FMHA", "softmax", "Softmax",
    "layernorm", "LayerNorm", "rmsnorm", "RMSNorm", "silu", "gelu", "relu", "rope", "RoPE",
    "topk", "TopK", "embedding", "Embedding", "memcpy", "memset", "Memcpy", "Memset",
    "teco", "Teco", "tccl", "TCCL", "sdaa", "SDAA", "tecoblas", "tecolmk", "tecodnn",
    "tecocustom", "nvjet", "cutlass", "cublas",
]

# Keyword classifier: ordered categories, each with its words (matched case-insensitively).
KEYWORD_CATEGORIES = {
    "conv_bn": ["convolution", "batch_norm", "conv2d", "conv3d", "cudnn", "ncxdhw", "conv_bn",
                "implicitgemm", "nchw2ncxhw", "nchw2cxhwn", "ncxhwn", "nchw2ncxhw32", "nchw2cxhwn32"],
    "attention": ["flash_fwd_kernel", "flash_bwd_kernel", "attention", "scaled_dot_product",
                  "flash_attn", "fwd_kernel", "bwd_kernel"],
    "norm": ["layer_norm", "rms_norm", "group_norm", "instance_norm", "layernorm", "rnsnorm",
             "RowwiseMoments", "NormalizeKernel", "ComputeFusedParams", "GroupNorm", "GroupNormKernel"],
    "gemm": ["Cijk", "gemm", "matmul", "bmm", "linear", "cublasLt", "cublas"],
    "elementwise": ["add", "mul", "sub", "div", "relu", "gelu", "silu", "sigmoid", "tanh", "softmax",
                    "dropout", "where", "clamp", "abs", "pow", "sqrt", "exp", "log", "neg", "reciprocal",
                    "elementwise", "vectorized_elementwise", "FillFunctor", "CUDAFunctor"],
    "访存": ["memcpy", "MemCpy", "cudaMemcpy", "mem_set", "memset", "MemcpyAsync"],
    "at::native": ["sum", "mean", "max", "min", "prod", "argmax", "argmin", "ReduceKernel", "ReduceOp",
                   "index", "gather", "scatter", "slice", "select", "embedding", "vectorized_gather",
                   "indexSelectLargeIndex", "reshape", "view", "permute", "transpose", "contiguous",
                   "clone", "CopyKernel", "bfloat16_copy"],
}
KEYWORD_KERNEL_FALLBACK = {
    "gemm": ["gemm", "matmul", "bmm"],
    "attention": ["flash", "attention"],
    "conv_bn": ["conv", "cudnn"],
    "norm": ["norm", "layer_norm"],
    "elementwise": ["elementwise", "ew"],
}
# Share of summed kernel time above which advice is given, in percent.
ADVICE_THRESHOLDS = {"gemm": 30.0, "attention": 25.0, "conv_bn": 20.0, "elementwise": 20.0, "访存": 10.0}

# Python frames that do not name a source location.
UNINFORMATIVE_FRAMES = [
    "<built-in", "torch/_ops.py", "torch/nn/modules/module.py", "triton/runtime/",
    "triton/backends/", "threading.py", "_bootstrap",
]

# Gated-delta-network source scopes.
GDN_CORE_OPS = [
    "vllm::gdn_attention_core",
    "vllm::qwen_gdn_attention_core",
    "vllm::qwen_gdn_attention_core_fused_norm_packed",
]
GDN_CORE_SUBSCOPES = {
    ": rearrange_mixed_qkv": "rearrange",
    ": fused_gdn_gating": "gating",
    "_C_sdaa::fused_gdn_gating": "gating",
    ": l2norm": "qk_norm",
    "_C_sdaa::chunk_gated_delta_rule_fwd": "chunk_fwd",
    ": fi_chunk_gated_delta_rule": "chunk_fwd",
    "_C_sdaa::fused_recurrent_gated_delta_rule_fwd": "recurrent",
    ": fused_recurrent_gated_delta_rule": "recurrent",
    ": fused_sigmoid_gating_delta_rule_update": "recurrent_fused",
    ": fused_recurrent_gated_delta_rule_packed_decode": "recurrent_packed",
}
GDN_PYTHON_SCOPES = [
    "%/mamba/gdn/qwen_gdn_linear_attn.py(%): _output_projection",
    "%/attention/backends/gdn_attn.py(%): _build_chunk_metadata",
    "%/mamba/gdn/qwen_gdn_linear_attn.py(%): rearrange_mixed_qkv",
    "%/layers/mamba/gdn_linear_attn.py(%): rearrange_mixed_qkv",
    "%/mamba/gdn/qwen_gdn_linear_attn.py(%): fi_chunk_gated_delta_rule",
    "%/mamba/gdn/qwen_gdn_linear_attn.py(%): fused_gdn_gating",
    "%/vllm_sdaa/layers/mamba/gdn_linear_attn.py(%): fused_gdn_gating",
    "%/vllm_sdaa/layers/fla/ops/chunk.py(%): l2norm",
    "%/fla/ops/fused_recurrent.py(%): fused_recurrent_gated_delta_rule",
    "%/flash_linear_attention/ops/fused_recurrent.py(%): fused_recurrent_gated_delta_rule_packed_decode",
    "%/flash_linear_attention/ops/fused_sigmoid_gating.py(%): fused_sigmoid_gating_delta_rule_update",
    "%): causal_conv1d_update",
    "%): causal_conv1d_fn",
]
GDN_NORM_OP = "_C_sdaa::fused_norm"
GDN_OUTPUT_SYMBOLS = {
    "triton_per_fused__to_copy__unsafe_view_add_clone_mean_mul_pow_rsqrt_silu_view_0": "gdn_output_norm",
    "triton_poi_fused__to_copy__unsafe_view_add_clone_mean_mm_mul_pow_rsqrt_silu_t_view_1": "gdn_output_layout",
}
GDN_SHARED_CATEGORIES = ["其他elementwise", "Triton", "memcpy/memset"]

# Operator labels and comparison groups of gated-delta-network subtypes, in report order.
GDN_OPERATOR_GROUPS = {
    "causal_conv1d": ["gdn_conv"],
    "causal_conv1d_update": ["gdn_conv_update"],
    "因果卷积（共享核）": ["gdn_conv_shared"],
    "rearrange_mixed_qkv": ["gdn_rearrange_qkv"],
    "fused_gdn_gating": ["gdn_gating"],
    "Q/K L2 Norm": ["gdn_qk_norm"],
    "QKV 重排、门控与 Q/K 归一化融合": ["gdn_gating_qk_fused"],
    "chunk_gated_delta_rule_fwd": ["gdn_chunk_prepare", "gdn_chunk_state", "gdn_chunk_output",
                                   "gdn_chunk_prefill", "gdn_chunk_fixup", "gdn_chunk_fwd_internal"],
    "fused_recurrent_gated_delta_rule_fwd": ["gdn_recurrent"],
    "门控与递推融合": ["gdn_recurrent_fused"],
    "Packed QKV、门控与递推融合": ["gdn_recurrent_packed"],
    "输出门控 RMSNorm": ["gdn_output_norm"],
    "输出布局": ["gdn_output_layout"],
    "元数据准备": ["gdn_metadata"],
    "核心内部辅助计算": ["gdn_aux"],
    "内部内存搬运": ["gdn_memory"],
}
GDN_COMPARISON_GROUPS = {
    "卷积": ["gdn_conv"],
    "卷积状态更新": ["gdn_conv_update"],
    "卷积后准备": ["gdn_rearrange_qkv", "gdn_gating", "gdn_qk_norm", "gdn_gating_qk_fused"],
    "Chunk 主计算": ["gdn_chunk_prepare", "gdn_chunk_state", "gdn_chunk_output",
                     "gdn_chunk_prefill", "gdn_chunk_fixup", "gdn_chunk_fwd_internal"],
    "递推主计算": ["gdn_recurrent", "gdn_recurrent_fused", "gdn_recurrent_packed"],
    "输出门控及布局": ["gdn_output_norm", "gdn_output_layout"],
    "元数据准备": ["gdn_metadata"],
    "实现辅助": ["gdn_aux", "gdn_memory"],
}
GDN_DECODE_GROUP = "卷积后准备与递推"
GDN_UNALIGNED_GROUP = "未对齐 GDN 子项"
GDN_CORE_STAGES = ["卷积", "卷积状态更新", "卷积后准备", "Chunk 主计算", "卷积后准备与递推", "递推主计算"]
GDN_COMPARISON_OPERATORS = {
    "gdn_conv": "causal_conv1d_fn",
    "gdn_conv_update": "causal_conv1d_update",
    "gdn_rearrange_qkv": "rearrange_mixed_qkv",
    "gdn_gating": "fused_gdn_gating",
    "gdn_qk_norm": "l2norm",
    "gdn_gating_qk_fused": "_fused_post_conv_kernel",
    "gdn_recurrent": "fused_recurrent_gated_delta_rule_fwd",
    "gdn_recurrent_fused": "fused_sigmoid_gating_delta_rule_update_kernel",
    "gdn_recurrent_packed": "fused_recurrent_gated_delta_rule_packed_decode_kernel",
    "gdn_output_norm": "gated RMSNorm",
    "gdn_output_layout": "output layout",
    "gdn_metadata": "metadata preparation",
    "gdn_aux": "indexing/layout helpers",
    "gdn_memory": "Memcpy/Memset",
}
# Time-account rows, in report order.
TIME_ROWS = ["类别合计", "等待/同步 WAIT/SET", "设备调用合计（加总）", "重叠/边界调整",
             "设备覆盖时长（去重）", "空泡", "窗口总时间"]
BUBBLE_LABEL = "空泡 (bubble)"
TOTAL_LABEL = "总计"
EXCLUDED_LABEL = "非计算/排除"

# Comparison blockers.
BLOCKER_STAGE = "阶段未确认一致"
BLOCKER_MIXED = "窗口含混合轮次或阶段冲突"
BLOCKER_RANK = "rank 不同"
BLOCKER_RULES = "分类规则校验值未确认一致"
BLOCKER_WORK = "实际窗口工作量不同"
BLOCKER_UNVERIFIED = "工作量尚未核实"
GDN_CONFIRMED_SUBSET = "GDN（已确认子集）"
# The delta-network group that is named after its kernel, and the kernels, first match first: (kind of match, text, label).
GDN_METADATA_GROUP = "元数据准备"
GDN_METADATA_KERNELS = [("contains", "gdn_prepare_cudagraph_impl", "gdn_prepare_cudagraph_impl"), ("startswith", "Memcpy HtoD", "Memcpy HtoD")]

# Occupancy labels.
OWNER_GONE = "（进程已退出）"
OWNER_HOST = "宿主机进程"
OWNER_UNKNOWN = "?"
LIST_SEPARATOR = "、"

# Window annotations.
DECODE_ANNOTATION = r"^execute_context_.*_generation_[1-9]\d*\("
PREFILL_ANNOTATION = r"^execute_context_[1-9]\d*\("
CONTEXT_ANNOTATION = r"^execute_context_(\d+)\((\d+)\)_generation_(\d+)\((\d+)\)"
GRAPH_LAUNCH_API = r"^(sdaa|cuda|hip)GraphLaunch(_.*)?$"
RANK_IN_FILE_NAME = r"_rank(\d+)[._]"

# Sample kernel names of the driver views.
DEVICE_NAMES = [
    "void slave_gemm_m8n256k128_fp16<1536u, false, false>(GemmM8N256K128Args)",
    "tecoblas::ual::slave::teco_slave_gemm_NN_Afp16_Bfp16_Cfp16_N256_NOPAD(GemmWrapArgs)",
    "void slave_mm_dequantize_v3<1536u>(void const*, void const*, void*, int, int, int)",
    "void tccl_move_data_list<8192ul>(tcclMove)",
    "tecoblas::ual::slave::teco_slave_gemm_NT_Afp16_Bfp16_Cfp16_allReduce(GemmWrapArgs)",
    "tecocustom::ual::kernel::teco_slave_flash_attention_forward_8_4_64_false_general_hd256(Args)",
    "void tecolmk_slave_fused_block_attention_decode_v2<256u, 32u>(BlockAttentionLayerArgs)",
    "void tecolmk_slave_fused_norm<2, 1>(FusedNormArgs)",
    "void tecolmk_slave_compute_v_new_last_state<1>(ChunkGatedDeltaRuleArgs)",
    "tecodnn::ual::slave::teco_slave_broadcast_add(tecodnn::ual::ops::BroadcastArgs)",
    "tecodnn::ual::slave::teco_slave_no_broadcast_mul(tecodnn::ual::ops::NoBroadcastArgs)",
    "tecolmk_slave_prefill_cache(BlockAttentionLayerArgs)",
    "_Z42tecolmk_slave_fused_qk_gemma_norm_mrope_kernel_impl(Args)",
    "tecodnn::ual::slave::teco_slave_copy_stride_dma_2D<unsigned short>(CopyStrideArgs)",
    "sdaart::sdaaMemcpyAsyncH2D",
    "WAIT",
    "nvjet_sm90_tst_192x8_64x8_4x1_v_bz_TNT",
    "void cublasLt::splitKreduce_kernel<32, 16>(Params)",
    "void cutlass::device_kernel<flash::FlashAttnFwdSm90<...>>(Params)",
    "void cutlass::device_kernel<flat::kernel::FlatKernelTmaWarpSpecializedDeltaRule<...>>(Params)",
    "void ncclKernel_AllReduce_RING_LL()",
    "triton_poi_fused_add_mul_0",
    "Cijk_Alik_Bljk_F8BS_MT16x16x64",
    "void CKFmhaFwdKernel<...>()",
    "rcclAllReduceRingKernel",
    "hipMemcpyAsync",
    "SET",
    "fused_moe_kernel",
    "void tecolmk_slave_gemm_grouped_batched_v2_weight_half<3, 64>(GemmGroupBatchArgsV2<64>)",
    "teco_slave_causal_conv1d_perf(Args)",
    "fused_gdn_gating_kernel",
    "opaque_zeta",
    "fused_recurrent_gated_delta_rule_packed_decode_kernel",
    "gdn_prepare_cudagraph_impl",
]
